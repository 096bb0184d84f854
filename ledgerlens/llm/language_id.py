"""Operator 6, language ID: prediction by partial matching over bytes.

Per language a context tree of order 0 to 3 is counted over a bounded sample
of labelled documents (``sample_docs`` documents a language of at most
``sample_bytes`` bytes each, the first by the hash of their id; only rows whose
id is not held out). The counts are frozen. A byte costs
``-log2(count / (n + q))`` in its longest context that has seen it (n: symbols
counted there, q: distinct ones); each longer known context pays its escape
``-log2(q / (n + q))``; below order 0 a byte costs 8 bits. The code length of
a text is the exact sum over all its bytes, and the shortest one wins.

Scoring is one narrow pass over whole texts: the trees are dense child tables
(node x byte -> node), all bytes of an Arrow batch walk them at once, and the
contexts restart with each document. The model is bounded by the sample, so it
is collected and broadcast; everything else covers all rows.

Edge cases: a null text, or one without any letter, is ``und`` with score 0;
so is every text if nothing was learned; ties go to the first language in
sorted order; rows with a null language teach nothing; repeated rows each get
a row; other columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, held_out, release_memory

ORDER = 3
SAMPLE_DOCS = 300
SAMPLE_BYTES = 20_000
SLICE = 1 << 20


def _joined(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows (null: empty)."""
    values = values.cast(pa.binary()).fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    data = values.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0]:offsets[-1]], offsets - offsets[0]


def gram_counts(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, gram, n): byte strings of size 1 to order + 1, packed big-endian."""

    def run(batches):
        for batch in batches:
            data, offsets = _joined(batch.column("text"))
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                doc = data[offsets[i]:offsets[i + 1]].astype(np.int64)
                for size in range(1, order + 2):
                    if len(doc) < size:
                        break
                    gram = np.zeros(len(doc) - size + 1, np.int64)
                    for k in range(size):
                        gram = gram * 256 + doc[k:len(doc) - size + 1 + k]
                    grams, n = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), size, np.int32)),
                         pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "size", "gram", "n"])
        release_memory()

    return (sample.select("lang", "text").mapInArrow(run, "lang string, size int, gram long, n long")
            .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))


class Trees:
    """The frozen statistics of all languages as arrays over shared tree nodes.

    Level k holds the strings of k bytes seen in any language; node 0 of a
    level means unseen. cost[k][node, lang] is the whole code length of the
    string's last byte after its first k - 1; escape[k][node, lang] what a
    byte pays that the node's context has not seen.
    """

    def __init__(self, langs: list[str], rows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], order: int):
        self.langs, self.order = langs, order
        n_langs = len(langs)
        seen = np.unique(rows[1][1])
        self.symbol = np.zeros(256, np.int32)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.child, self.cost, self.escape = [], [], []
        parents, last_cost = np.zeros(0, np.int64), None
        for size in range(1, order + 2):
            lang, gram, n = rows.get(size, (np.zeros(0, np.int64),) * 3)
            grams = np.unique(gram)
            count = np.zeros((len(grams) + 1, n_langs))
            np.add.at(count, (np.searchsorted(grams, gram) + 1, lang), n)
            up = np.searchsorted(parents, grams // 256) + 1 if size > 1 else np.zeros(len(grams), np.int64)
            n_up = len(parents) + 1
            total, distinct = np.zeros((n_up, n_langs)), np.zeros((n_up, n_langs))
            np.add.at(total, up, count[1:])
            np.add.at(distinct, up, count[1:] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(count[1:] / (total + distinct)[up])
            if size == 1:
                shorter = np.full((len(grams), n_langs), 8.0)
                floor = 8.0 + escape[0]
            else:
                suffix = np.searchsorted(self._grams, grams % 256 ** (size - 1)) + 1
                shorter = last_cost[suffix]
            cost = np.zeros((len(grams) + 1, n_langs))
            cost[1:] = np.where(count[1:] > 0, own, escape[up] + shorter)
            if size == 1:
                cost[0] = floor
            child = np.zeros(n_up * self.width, np.int32)
            child[up * self.width + self.symbol[grams % 256]] = np.arange(1, len(grams) + 1)
            self.child.append(child)
            self.cost.append(cost)
            self.escape.append(escape)
            parents, self._grams, last_cost = grams, grams, cost

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code lengths in bits: documents x languages."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        doc = 0
        while doc < len(offsets) - 1:
            end = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + SLICE, "right")) - 1)
            out[doc:end] = self._slice(data[offsets[doc]:offsets[end]], offsets[doc:end + 1] - offsets[doc])
            doc = end
        return out

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        if not len(full):
            return out
        starts = offsets[:-1][full]
        symbol = self.symbol[data]
        nodes, before = [], []
        at = np.zeros(len(data), np.int32)
        for k in range(self.order + 1):
            node = self.child[k][at * self.width + symbol]
            nodes.append(node)
            before.append(at)
            at = np.empty_like(node)
            at[1:] = node[:-1]
            at[starts] = 0
        cost = self.cost[self.order][nodes[self.order]]
        missing = np.flatnonzero(nodes[self.order] == 0) if self.order else np.zeros(0, np.int64)
        cost[missing] = 0
        for k in range(self.order, 0, -1):
            cost[missing] += self.escape[k][before[k][missing]]
            found = nodes[k - 1][missing]
            done = (found > 0) if k > 1 else np.ones(len(found), bool)
            cost[missing[done]] += self.cost[k - 1][found[done]]
            missing = missing[~done]
        out[full] = np.add.reduceat(cost, starts, axis=0)
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Trees | None:
    """Count the trees over the bounded sample; None if there is nothing to learn from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fit = rows.filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull()
                      & (F.octet_length("text") <= sample_bytes))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = (fit.select("id", "lang").filter("id IS NOT NULL").withColumn("k", F.row_number().over(first))
              .filter(F.col("k") <= sample_docs).select("id", "lang").distinct())
    # at most sample_docs rows a language
    sample = fit.join(F.broadcast(chosen), ["id", "lang"], "left_semi")
    got = gram_counts(sample, order).toPandas()
    if not len(got):
        return None
    langs = sorted(got["lang"].unique())
    code = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    by = {int(s): (code[m], got["gram"].to_numpy()[m], got["n"].to_numpy()[m])
          for s in sorted(got["size"].unique()) for m in [(got["size"] == s).to_numpy()]}
    return Trees(langs, by, order)


def identify(docs: DataFrame, model: Trees | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score (the winner's share of the likelihoods, 0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        trees = shared.value

        def compute(batch):
            column = batch.column(text_col)
            names, scores = ["und"] * len(column), [0.0] * len(column)
            if trees is not None:
                bits = trees.lengths(*_joined(column))
                best = bits.argmin(axis=1)
                share = 1.0 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                for i, text in enumerate(column.to_pylist()):
                    if text and next(filter(str.isalpha, text), None):
                        names[i], scores[i] = trees.langs[best[i]], float(share[i])
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return compute

    return add_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)
