"""Operator 3, benchmark decontamination: a prefix-filtered set join.

A window is 10 consecutive words of an item (the whole item when it has fewer,
but some). A document is hit where a window occurs in it.

Method. Containment of a whole window needs every one of its words, so its
prefix in any word order is a single word. Words are ordered by rarity (their
count over all documents, ties by the word) and each window is indexed under
its rarest one. A document word found in the index proposes ``start = position
- offset``; the positional bound (``start >= 0``) and the length bound (``start
+ size <= words``) come first, then the exact words of the document window are
compared with the windows of that (word, offset, size).

Scale. Both passes are narrow scans of the documents; only (word, count)
partial sums are shuffled. The window index is broadcast in blocks of at most
``block_windows`` windows (a proven bound, the benchmark may be any size); with
several blocks each is one pass, which carries the spans found so far in a
table. No document meets another, so copies and hot passages cannot skew it.

Edge cases: a null or empty text has no words and no hits; items without
words have no windows; windows of items with a null id hit, but name no item; repeated items count once by id;
repeated documents each get their own row; extra columns pass through, those
named like an output column are replaced; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, alnum_words, drop_table, texts, write_table

WINDOW = 10
BLOCK_WINDOWS = 100_000


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
            size: int = WINDOW) -> DataFrame:
    """(item string, window binary): the distinct windows of every item, words
    joined by one space."""

    def run(batches):
        for batch in batches:
            items, wins = [], []
            for item, text in zip(batch.column("item").to_pylist(), texts(batch, "text"), strict=True):
                words = alnum_words(text)
                n = min(size, len(words))
                for w in {b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)} if n else ():
                    items.append(item)
                    wins.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(wins, pa.binary())],
                                             names=["item", "win"])

    return (benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
            .filter("text IS NOT NULL")
            .mapInArrow(run, "item string, win binary").distinct())


def word_counts(docs: DataFrame, vocabulary, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of the broadcast vocabulary occurs in all documents."""

    def run(batches):
        known, count = vocabulary.value, Counter()
        for batch in batches:
            for text in texts(batch, text_col):
                count.update(filter(known.__contains__, alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()),
                                          pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    return docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rarity_index(pairs: list[tuple[str, bytes]], counts: dict[bytes, int]) -> dict:
    """{rarest word: {(offset, size): {window: items}}}."""
    index: dict = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for item, win in pairs:
        words = win.split(b" ")
        rarest = min(words, key=lambda w: (counts.get(w, 0), w))
        index[rarest][words.index(rarest), len(words)][win].append(item)
    return {w: {k: dict(v) for k, v in by.items()} for w, by in index.items()}


def _mark(docs: DataFrame, index, text_col: str, names: list[str], first: bool) -> DataFrame:
    """Adds what one block of windows finds, under ``names``: words, spans (start, end), items."""
    spans_t = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
    arrow_spans = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    kinds = (T.LongType(), spans_t, T.ArrayType(T.StringType()))
    fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]

    def make():
        table = index.value

        def compute(batch):
            n_words, spans, items = [], [], []
            old = None if first else zip(batch.column(names[1]).to_pylist(), batch.column(names[2]).to_pylist(), strict=True)
            for text in texts(batch, text_col):
                words = alnum_words(text)
                found, known = next(old) if old else ([], [])
                found, known = list(found), set(known)
                for at in [i for i, w in enumerate(words) if w in table]:
                    for (offset, size), wins in table[words[at]].items():
                        start = at - offset
                        if start < 0 or start + size > len(words):
                            continue
                        hit = wins.get(b" ".join(words[start:start + size]))
                        if hit:
                            found.append({"s": start, "e": start + size})
                            known.update(x for x in hit if x is not None)
                n_words.append(len(words))
                spans.append(found)
                items.append(sorted(known))
            return [pa.array(n_words, pa.int64()), pa.array(spans, arrow_spans), pa.array(items, pa.list_(pa.string()))]

        return compute

    return add_columns(docs, fields, make)


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """``wanted``, with underscores added until no name is taken in any spelling."""
    taken = {t.lower() for t in taken}
    out = []
    for name in wanted:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def covered(spans: Column) -> Column:
    """Length of the union of (s, e) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["e"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", size: int = WINDOW,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` plus n_words, n_hit, n_items, items (sorted ids), items_sha256, contaminated."""
    spark = docs.sparkSession
    wins = write_table(windows(benchmark, item_col, item_text_col, size), "bench-windows")
    blocks = max(1, -(-wins.count() // block_windows))
    out, held = docs, None
    names = free_names(docs.columns, ["_n", "_spans", "_items"])
    for b in range(blocks):
        # at most about block_windows rows: a block of a stated query set
        pairs = [(r["item"], bytes(r["win"])) for r in
                 wins.filter(F.pmod(F.xxhash64("item", "win"), F.lit(blocks)) == b).collect()]
        vocabulary = spark.sparkContext.broadcast(frozenset(w for _, win in pairs for w in win.split(b" ")))
        counts = {bytes(r["word"]): r["n"] for r in word_counts(docs, vocabulary, text_col).collect()} if pairs else {}
        out = _mark(out, spark.sparkContext.broadcast(rarity_index(pairs, counts)), text_col, names, b == 0)
        if b + 1 < blocks:
            out, last = write_table(out, "bench-marks"), held
            if last is not None:
                drop_table(last)
            held = out
    drop_table(wins)
    n, spans, items = names
    return (out.withColumn("n_words", F.col(n))
            .withColumn("n_hit", covered(F.col(spans)))
            .withColumn("n_items", F.size(items).cast("long"))
            .withColumn("items", F.col(items))
            .withColumn("items_sha256", F.sha2(F.array_join(items, ",").cast("binary"), 256))
            .withColumn("contaminated", F.col("n_hit") > 0)
            .drop(*names))
