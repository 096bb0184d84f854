"""Lexical (BM25 Okapi) retrieval as blocks, tables and joins.

Index = blocks of chunks, each one row that holds its chunks' ids, lengths and
counted terms, packed where the chunks lie, and a term table (term, df, idf),
plus the corpus scalars (N, avgdl, mean idf) as plain values. ``rows`` and
``postings`` (block, chunk_id, dl, term, tf; bucketed by block) are read from them.

A search packs the questions' terms into blocks too, and every block of chunks
meets every block of questions (Spark broadcasts the questions while they are
small). A task scores one such pair at a time and keeps the k best rows of a
question, so only those go to the final ranking: no pair of a question and a
chunk is shuffled, sorted or spilled.

A skipping search bounds before it scores: the largest weights of a question's
terms in a run of chunks add up to a bound of its scores there. The k runs of
largest bound are scored first; the k-th score so far is a floor of the
question's k-th score, so the runs whose bound is below it hold none of its k
best and are never scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.text import tokens
from ..session import cut_lineage, write_bucketed

# BM25 Okapi parameters (defaults of the public BM25 package the
# reference calls without arguments).
K1 = 1.5
B = 0.75
EPSILON = 0.25

# Question-side broadcast bound: bytes of the (question, term) rows.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# A bucket of the index holds about so many tokens.
BUCKET_TOKENS = 50_000_000
# A bucketed block of postings holds 2**BLOCK_SHIFT chunk ids.
BLOCK_SHIFT = 1
# Chunks of an index block, and of a run in it that is bounded as one; questions of a block, about.
CHUNK_BLOCK = 4096
RUN = 8
QUESTION_BLOCK = 1024
# So many (question, term, chunk) triples are held at once: few enough for a core's cache.
PIECE = 1 << 17
# So many terms of blocks are held for one sum of their document counts.
MERGED_TERMS = 1 << 21
# White space of ``tokens`` (Unicode's White_Space) as UTF-8: single bytes, and the longer ones as numbers.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
WIDE_SPACES = {n: np.array([int.from_bytes(c.encode(), "big") for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
                            "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000" if len(c.encode()) == n]) for n in (2, 3)}
WIDE_LEAD = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
# Ranks compare scores rounded to six digits; twice that also covers the order of a sum.
ROUNDING = 2e-6


@dataclass
class LexicalIndex:
    blocks: DataFrame  # n, total, ids, data (chunk_id, dl, terms [(term, tf)] of n chunks)   (materialised)
    raw_terms: DataFrame  # term, df, raw_idf       (materialised)
    chunk_id: S.DataType
    n_docs: int
    total_tokens: int
    avgdl: float
    vocabulary: int
    avg_idf: float
    buckets: int
    epsilon: float = EPSILON
    only: DataFrame | None = None  # rows of these chunk ids alone

    @property
    def rows(self) -> DataFrame:
        """(chunk_id, dl, terms [(term, tf)])."""
        rows = self.blocks.select("data").mapInArrow(_unpack, _rows_schema(self.chunk_id))
        return rows if self.only is None else rows.join(
            self.only, rows["chunk_id"].eqNullSafe(self.only["chunk_id"]), "left_semi")

    @cached_property
    def repeated(self) -> DataFrame | None:
        """The chunk ids that stand in several rows, or None: their rows' scores add up."""
        again = cut_lineage(self.blocks.select(F.explode("ids").alias("chunk_id"))
                            .groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("chunk_id"), "repeated")
        return None if again.isEmpty() else again

    @cached_property
    def alone(self) -> DataFrame:
        """The blocks without the repeated chunk ids."""
        if self.repeated is None:
            return self.blocks
        rows = self.rows
        once = rows.join(self.repeated, rows["chunk_id"].eqNullSafe(self.repeated["chunk_id"]), "left_anti")
        listed = once.select("chunk_id", F.flatten(F.transform("terms", lambda t: F.array_repeat(t["term"], t["tf"].cast("int")))).alias("tokens"))
        return cut_lineage(listed.mapInArrow(_pack, _blocks_schema(self.chunk_id)), "index-alone")

    @cached_property
    def postings(self) -> DataFrame:
        """(block, chunk_id, dl, term, tf), bucketed by block; written at the first use."""
        whole = self.chunk_id.typeName() in ("byte", "short", "integer", "long")
        own = F.shiftright(F.col("chunk_id").cast("long"), BLOCK_SHIFT) if whole else F.pmod(
            F.xxhash64("chunk_id"), F.lit(max(1, self.n_docs >> BLOCK_SHIFT)))
        rows = self.rows.select(F.coalesce(own, F.lit(-1)).cast("long").alias("block"), "chunk_id", "dl", "terms")
        kept = write_bucketed(rows.repartition(self.buckets, "block"), "block", self.buckets, "postings")
        return kept.select("block", "chunk_id", "dl", F.inline("terms"))

    def weight(self, k1: float, b: float) -> F.Column:
        """A posting's part of a score, before its question count and idf."""
        return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(self.avgdl or 1.0)))

    @property
    def terms(self) -> DataFrame:
        """(term, df, idf): negative idf replaced by epsilon x mean idf."""
        return self.raw_terms.select("term", "df", F.when(F.col("raw_idf") < 0, F.lit(self.epsilon * self.avg_idf))
                                    .otherwise(F.col("raw_idf")).alias("idf"))

    @property
    def stats(self) -> DataFrame:
        spark = self.blocks.sparkSession
        return spark.createDataFrame(
            [(self.n_docs, self.total_tokens, self.avgdl, self.vocabulary, self.avg_idf)],
            "n_docs long, total_tokens long, avgdl double, vocabulary long, avg_idf double")


def _rows_schema(chunk_id: S.DataType) -> S.StructType:
    entry = S.StructType([S.StructField("term", S.StringType()), S.StructField("tf", S.LongType())])
    return S.StructType([S.StructField("chunk_id", chunk_id), S.StructField("dl", S.LongType()),
                         S.StructField("terms", S.ArrayType(entry))])


def _blocks_schema(chunk_id: S.DataType) -> S.StructType:
    return S.StructType([S.StructField("n", S.LongType()), S.StructField("total", S.LongType()),
                         S.StructField("ids", S.ArrayType(chunk_id)), S.StructField("data", S.BinaryType())])


def _words(texts: pa.Array) -> pa.ListArray:
    """The words of lower-cased texts, cut as ``tokens`` cuts them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    space = SPACE[data]
    at = np.flatnonzero(WIDE_LEAD[data])
    for n, wide in WIDE_SPACES.items():
        at = at[at <= len(data) - n]
        code = sum(data[at + i].astype(np.int64) << 8 * (n - 1 - i) for i in range(n))
        space[at[np.isin(code, wide)][:, None] + np.arange(n)] = True
    first = np.ones(len(data), bool)
    first[1:] = space[:-1]
    first[ends[ends < len(data)]] = True
    first &= ~space
    kept = data[~space]
    starts = np.append(np.flatnonzero(first[~space]), len(kept)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(kept))
    return pa.ListArray.from_arrays(np.searchsorted(np.flatnonzero(first), ends).astype(np.int32), words)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (chunk_id, lower-cased text or its tokens) as blocks: their terms counted, sorted inside a chunk, coded by the block's own list."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_BLOCK):
            part = batch.slice(at, CHUNK_BLOCK)
            listed = part.column(1)
            if not pa.types.is_nested(listed.type):
                listed = _words(listed)
            dl = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = pc.dictionary_encode(listed.flatten())
            by_term = pc.array_sort_indices(words.dictionary).to_numpy()
            place = np.empty(len(by_term), np.int64)
            place[by_term] = np.arange(len(by_term))
            codes = place[words.indices.to_numpy(zero_copy_only=False)]
            key, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * max(1, len(by_term)) + codes, return_counts=True)
            row, code = np.divmod(key, max(1, len(by_term)))
            lists = {"chunk_id": part.column(0), "dl": pa.array(dl), "terms": words.dictionary.take(pa.array(by_term)),
                     "entries": pa.array(np.bincount(row, minlength=len(dl)).astype(np.int32)),
                     "code": pa.array(code.astype(np.int32)), "tf": pa.array(tf.astype(np.int32))}
            held = pa.record_batch({name: pa.ListArray.from_arrays([0, len(x)], x) for name, x in lists.items()})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema) as out:
                out.write_batch(held)
            yield pa.record_batch({"n": [len(dl)], "total": [int(dl.sum())], "ids": held.column("chunk_id"),
                                   "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _block(data: bytes) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """A block's chunk ids, lengths and terms, and the row, code and count of each entry."""
    held = pa.ipc.open_stream(data).read_next_batch()
    ids, dl, terms, entries, code, tf = (c.flatten() for c in held.columns)
    return ids, dl.to_numpy(), terms, np.repeat(np.arange(len(ids)), entries.to_numpy()), code.to_numpy(), tf.to_numpy()


def _blocks(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for data in batch.column(0):
            yield _block(data.as_py())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) summed over blocks, as many as have MERGED_TERMS terms together."""
    held, size = [], 0

    def summed() -> Iterator[pa.RecordBatch]:
        both = pa.concat_tables(held).group_by("term").aggregate([("df", "sum")])
        yield from both.select(["term", "df_sum"]).rename_columns(["term", "df"]).to_batches()

    for _, _, terms, _, code, _ in _blocks(batches):
        held.append(pa.table({"term": terms, "df": pa.array(np.bincount(code, minlength=len(terms)))}))
        size += len(terms)
        if size >= MERGED_TERMS:
            yield from summed()
            held, size = [], 0
    if held:
        yield from summed()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, dl, terms, row, code, tf in _blocks(batches):
        entries = pa.StructArray.from_arrays([terms.take(pa.array(code)), pa.array(tf.astype(np.int64))], ["term", "tf"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ids)))]).astype(np.int32)
        yield pa.record_batch({"chunk_id": ids, "dl": pa.array(dl), "terms": pa.ListArray.from_arrays(pa.array(ends), entries)})


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
                epsilon: float = EPSILON, num_buckets: int | None = None) -> LexicalIndex:
    """Build the index once: one pass over the text writes blocks of chunks with
    their distinct terms and counts, without a shuffle; from there come N, the
    token total and the terms' document counts, summed inside a block first.
    Postings have ``num_buckets`` buckets, or as many as the token total asks for.

    A null or empty chunk counts in N and has no postings.
    """
    spark = chunks.sparkSession
    chunk_id = chunks.schema[id_col].dataType
    lowered = chunks.select(F.col(id_col).alias("chunk_id"), F.lower(text_col).alias("text"))
    blocks = cut_lineage(lowered.mapInArrow(_pack, _blocks_schema(chunk_id)), "index-blocks")
    one = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("t")).first()
    n_docs, total = int(one["n"]), int(one["t"])
    buckets = num_buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-total // BUCKET_TOKENS))
    raw = cut_lineage(
        blocks.select("data").mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        .withColumn("raw_idf", F.log(F.lit(float(n_docs)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)),
        "terms")
    two = raw.agg(F.count(F.lit(1)).alias("v"), F.avg("raw_idf").alias("a")).first()
    avgdl = total / n_docs if n_docs else 0.0
    return LexicalIndex(blocks, raw, chunk_id, n_docs, total, avgdl, int(two["v"]),
                        float(two["a"] or 0.0), buckets, epsilon)


def question_terms(questions: DataFrame, id_col: str = "question_id",
                   text_col: str = "question") -> DataFrame:
    """(question_id, term, qtf): repeated question words count repeatedly."""
    return (questions.select(F.col(id_col).alias("question_id"),
                             F.explode(tokens(F.col(text_col))).alias("term"))
            .groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def small(df: DataFrame, text: str | None = None) -> DataFrame:
    """``df``, marked for broadcast if its rows (64 bytes each and ``text``) fit the bound."""
    held = df.agg(F.sum(F.lit(64) + (F.octet_length(text) if text else F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if held <= MAX_BROADCAST_BYTES else df


def _weighted(index: LexicalIndex, questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(question_id, term, qtf, idf), written once."""
    asked = question_terms(questions, id_col, text_col)
    return cut_lineage(asked.join(index.terms.select("term", "idf"), "term"), "question-terms")


def _sums(index: LexicalIndex, hits: DataFrame, k1: float, b: float) -> DataFrame:
    part = F.col("qtf") * F.col("idf") * index.weight(k1, b)
    return hits.groupBy("question_id", "block", "chunk_id").agg(F.sum(part).alias("lexical_score")).drop("block")


def score(index: LexicalIndex, questions: DataFrame, id_col: str = "question_id",
          text_col: str = "question", k1: float = K1, b: float = B) -> DataFrame:
    """M2 + J3: BM25 score of every chunk sharing a term with a question."""
    terms = small(_weighted(index, questions, id_col, text_col), "term")
    return _sums(index, index.postings.join(terms, "term"), k1, b)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts``, so many entries: whose they are and their number there."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)


def _pieces(counts: np.ndarray) -> Iterator[slice]:
    """Slices of ``counts`` that sum to about PIECE each."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield slice(at, to)
        at = to


class _Asked:
    """A block of questions, and the k best rows of each so far."""

    def __init__(self, asked: pa.StructArray, k: int, chunk_id: pa.DataType):
        question, term, part = (asked.field(i) for i in range(3))
        numbered = pc.dictionary_encode(question, null_encoding="encode")
        self.ids, self.k, self.n = numbered.dictionary, k, len(numbered.dictionary)
        coded = pc.dictionary_encode(term)
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.terms = coded.dictionary
        self.question = numbered.indices.to_numpy()[order]
        self.part = part.to_numpy()[order]
        self.count = np.bincount(code, minlength=len(self.terms))
        self.start = np.cumsum(self.count) - self.count
        self.floor = np.full(self.n, -np.inf)
        self.best = pa.table({"q": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "id": pa.array([], chunk_id)})

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        """``scores``: rows x questions, -inf where no term is shared."""
        kk = min(self.k, len(scores))
        kth = np.partition(scores, len(scores) - kk, axis=0)[len(scores) - kk]
        row, q = np.nonzero((scores >= np.maximum(self.floor, kth) - ROUNDING) & (scores > -np.inf))
        if not len(row):
            return
        new = pa.table({"q": pa.array(q), "s": pa.array(np.round(scores[row, q], 6) + 0.0), "id": ids.take(pa.array(row))})
        both = pa.concat_tables([self.best, new])
        both = both.take(pc.sort_indices(both, [("q", "ascending"), ("s", "descending"), ("id", "ascending")], null_placement="at_start"))
        q = both["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.best = both.filter(pa.array(place < self.k)).combine_chunks()
        last = place == self.k - 1
        self.floor[q[last]] = both["s"].to_numpy()[last]


def _score_block(block: tuple, asked: _Asked, skip: bool, k1: float, b: float, avgdl: float) -> None:
    ids, dl, terms, row, code, tf = block
    code = pc.fill_null(pc.index_in(terms, asked.terms), -1).to_numpy()[code]
    hit = code >= 0
    row, code, tf = row[hit], code[hit], tf[hit]
    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
    # a run's hits of a term, together
    key = row // RUN * len(asked.terms) + code
    order = np.argsort(key, kind="stable")
    row, code, weight = row[order], code[order], weight[order]
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    size = np.diff(first, append=len(row))
    if not len(first):
        return
    runs, group_code = row[first] // RUN, code[first]
    group, nth = _spread(asked.count[group_code])
    at = asked.start[group_code[group]] + nth
    run, q, part = runs[group], asked.question[at], asked.part[at]

    def scored(live: np.ndarray) -> None:
        """Score the live (run, question) pairs."""
        use = np.flatnonzero(live[run, q])
        cells = np.zeros(len(ids) * asked.n)
        seen = np.zeros(len(cells), bool)
        for some in _pieces(size[group[use]]):
            mine = use[some]
            whose, nth = _spread(size[group[mine]])
            post = first[group[mine[whose]]] + nth
            cell = row[post] * asked.n + q[mine[whose]]
            np.add.at(cells, cell, part[mine[whose]] * weight[post])
            seen[cell] = True
        asked.add(ids, np.where(seen, cells, -np.inf).reshape(len(ids), asked.n))

    n_runs = -(-len(ids) // RUN)
    if not skip:
        return scored(np.ones((n_runs, asked.n), bool))
    top = np.maximum.reduceat(weight, first)
    bound = np.bincount(run * asked.n + q, np.maximum(part * top[group], 0.0), n_runs * asked.n).reshape(n_runs, asked.n)
    shared = np.zeros(bound.shape, bool)
    shared[run, q] = True
    bound[~shared] = -np.inf
    done = np.zeros(bound.shape, bool)
    if np.isneginf(asked.floor).any():  # every such run shares a term: k of them hold k scored chunks at least
        kth = np.partition(bound, max(0, n_runs - asked.k), axis=0)[max(0, n_runs - asked.k)]
        done = shared & (bound >= kth) & np.isneginf(asked.floor)
        scored(done)
    left = shared & ~done & (bound >= asked.floor - ROUNDING)
    if left.any():
        scored(left)


def _search(k: int, skip: bool, k1: float, b: float, avgdl: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, _Asked] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = _block(batch.column("data")[i].as_py())
                number = batch.column("number")[i].as_py()
                if number not in met:
                    met[number] = _Asked(batch.column("asked")[i].values, k, block[0].type)
                _score_block(block, met[number], skip, k1, b, avgdl)
        for asked in met.values():
            if len(asked.best):
                yield pa.record_batch([asked.ids.take(asked.best["q"].combine_chunks()), asked.best["id"].combine_chunks(),
                                       asked.best["s"].combine_chunks()], ["question_id", "chunk_id", "lexical_score"])

    return run


def best_scores(index: LexicalIndex, questions: DataFrame, k: int, id_col: str = "question_id",
                text_col: str = "question", k1: float = K1, b: float = B, skip: bool = True) -> DataFrame:
    """The scores of the chunks that can be among the ``k`` best of a question:
    of each task's chunks the k best, rounded as ranks are, ties to smaller ids.
    With ``skip``, runs of chunks that cannot hold one of them are not scored.

    Scores of rows that share a chunk id add up over the whole corpus, so these
    ids are scored by ``score``."""
    weighted = _weighted(index, questions, id_col, text_col)
    asked_n = weighted.select("question_id").distinct().count()
    numbers = -(-asked_n // QUESTION_BLOCK) or 1
    asked = cut_lineage(weighted.groupBy(F.pmod(F.xxhash64("question_id"), F.lit(numbers)).alias("number"))
                        .agg(F.sort_array(F.collect_list(F.struct("question_id", "term", (F.col("qtf") * F.col("idf")).alias("part"))))
                             .alias("asked")), "asked")
    held = weighted.agg(F.sum(F.lit(32) + F.octet_length("term"))).first()[0] or 0
    tiles = index.alone.select("data").crossJoin(F.broadcast(asked) if held <= MAX_BROADCAST_BYTES else asked)
    out = S.StructType([S.StructField("question_id", weighted.schema["question_id"].dataType),
                        S.StructField("chunk_id", index.chunk_id), S.StructField("lexical_score", S.DoubleType())])
    hits = tiles.mapInArrow(_search(k, skip, k1, b, index.avgdl or 1.0), out)
    again = index.repeated
    if again is None:
        return hits
    among = score(replace(index, only=again), questions, id_col, text_col, k1, b)
    return hits.unionByName(among)


def top_k(scored: DataFrame, k: int, score_col: str, rank_col: str, ascending: bool,
          id_col: str = "chunk_id", digits: int = 6) -> DataFrame:
    """Rank per question by the rounded score, ties by id; keep rank <= k."""
    s = F.round(score_col, digits)
    order = s.asc() if ascending else s.desc()
    w = Window.partitionBy("question_id").orderBy(order, F.col(id_col).asc())
    return (scored.withColumn(score_col, s)
            .withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k))


def lexical_topk(index: LexicalIndex, questions: DataFrame, k: int = 10,
                 id_col: str = "question_id", text_col: str = "question", skip: bool = False) -> DataFrame:
    """(question_id, chunk_id, lexical_score, lexical_rank).

    With ``skip``, runs of chunks that cannot hold one of the ``k`` best are not
    scored. The rows are the same."""
    scored = best_scores(index, questions, k, id_col, text_col, skip=skip)
    return top_k(scored, k, "lexical_score", "lexical_rank", ascending=False)
