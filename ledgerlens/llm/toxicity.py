"""Operator 9, toxicity: nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled rows (``per_class`` toxic and as many
clean ones, and ``calibration`` others to calibrate on; the first by the hash
of their id, of at most ``sample_bytes`` bytes; never a held-out id). Terms are
the words that are ``ODDS`` times as frequent in one class as in the other and
whose share of toxic examples differs from the average by ``Z`` standard errors (in ``MIN_EXAMPLES`` examples at least; at most ``MAX_TERMS``, the strongest); their document
frequencies are counted over all documents. A text's vector holds
``(1 + log tf) * idf`` of its terms, at length 1.

Index: examples in blocks of ``BLOCK``; for every term and block the weights and
their maximum. A text adds up the block maxima of its terms, scores the most
promising blocks, and then every block whose bound still reaches the k-th best
cosine, so the k nearest examples are exact (ties to the earlier example).
Their labels vote, weighted by cosine; votes become probabilities by a monotone
fit (pool adjacent violators) on the calibration rows, which the index does not
hold. The nearest examples' ids are the evidence.

Scale. Two narrow passes over whole texts (term counts, scores); only partial
counts are shuffled. Sample, terms and index are bounded by parameters.

Edge cases: a text without any term (null and empty ones too) has no
neighbours: its score is the share of toxic rows among such calibration rows;
without labels of both classes every score is the toxic share of the labels (0
without any); repeated labels of one id count as toxic if one says so; rows
with null ids or labels teach nothing; repeated documents are scored each;
other columns pass through, those named like an output are replaced.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, alnum_words, held_out, texts

PER_CLASS = 1500
CALIBRATION = 3000
SAMPLE_BYTES = 20_000
Z = 5.0
ODDS = 4.0
MIN_EXAMPLES = 5
MAX_TERMS = 1024
BLOCK = 64
K = 16
THRESHOLD = 0.3


def sample(docs: DataFrame, labels: DataFrame, per_class: int, calibration: int) -> tuple[list, list]:
    """(examples, calibration rows) as (id, label, text), collected: bounded by the parameters."""
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("y"))
             .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id")).groupBy("id").agg(F.max("y").alias("y")))
    small = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).select(F.col("doc_id").cast("long").alias("id")).distinct()
    ranked = (known.join(small, "id", "left_semi").withColumn("h", F.xxhash64("id"))
              .withColumn("i", F.row_number().over(Window.partitionBy("y", F.pmod("h", F.lit(4)) > 0).orderBy("h", "id"))))
    fit = F.pmod("h", F.lit(4)) > 0
    # examples from three quarters of the rows, class by class; calibration rows from the last, as they come
    examples = ranked.filter(fit & (F.col("i") <= per_class)).select("id", "y", F.lit(0).alias("use"))
    others = ranked.filter(~fit).orderBy("h", "id").limit(calibration).select("id", "y", F.lit(1).alias("use"))
    chosen = F.broadcast(examples.unionByName(others))
    rows = (docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
            .join(chosen, "id").groupBy("id", "y", "use").agg(F.min("text").alias("text")).orderBy("id").collect())
    return tuple([(r["id"], r["y"], r["text"].encode()) for r in rows if r["use"] == use] for use in (0, 1))


def choose_terms(examples: list) -> list[bytes]:
    """Words tied to a label by at least Z standard errors, the strongest first."""
    n, toxic, known = Counter(), Counter(), set()
    for _, y, text in examples:
        seen = set(alnum_words(text))
        # of a group of near copies one speaks: their own words are no sign of the label
        copy = tuple(sorted(map(crc32, seen))[:2])
        if copy in known:
            continue
        known.add(copy)
        n.update(seen)
        if y:
            toxic.update(seen)
    share = sum(y for _, y, _ in examples) / max(1, len(examples))
    if not 0 < share < 1:
        return []
    bad = sum(y for _, y, _ in examples)
    good = len(examples) - bad

    def lift(w):
        return (toxic[w] + 0.5) / (bad + 1) * (good + 1) / (n[w] - toxic[w] + 0.5)

    z = {w: (toxic[w] - c * share) / (c * share * (1 - share)) ** 0.5 for w, c in n.items()
         if c >= MIN_EXAMPLES and not 1 / ODDS < lift(w) < ODDS}
    return sorted((w for w in z if abs(z[w]) >= Z), key=lambda w: (-abs(z[w]), w))[:MAX_TERMS]


def document_counts(docs: DataFrame, terms) -> dict[bytes, int]:
    """In how many documents each term occurs, and the number of documents (under b"")."""

    def run(batches):
        known, count = terms.value, Counter()
        for batch in batches:
            count[b""] += batch.num_rows
            for text in texts(batch, "text"):
                count.update(known.intersection(alnum_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    got = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in got}


class Index:
    """Block-max inverted index of the examples."""

    def __init__(self, examples: list, terms: list[bytes], counts: dict[bytes, int], k: int = K):
        self.k, self.at = k, {w: i for i, w in enumerate(terms)}
        total = counts.get(b"", 0)
        self.idf = np.array([np.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in terms])
        blocks = max(1, -(-len(examples) // BLOCK))
        weights = np.zeros((len(terms), blocks * BLOCK))
        for i, (_, _, text) in enumerate(examples):
            where, values = self.vector(text)
            weights[where, i] = values
        self.weights = weights.reshape(len(terms), blocks, BLOCK)
        self.most = self.weights.max(axis=2)
        self.ids = np.array([e[0] for e in examples], np.int64)
        self.labels = np.array([e[1] for e in examples], np.float64)
        self.steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
        self.without = 0.0

    def vector(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        tf = Counter(map(self.at.get, filter(self.at.__contains__, alnum_words(text))))
        where = np.array(sorted(tf), np.int64)
        values = (1 + np.log([tf[i] for i in where.tolist()])) * self.idf[where] if len(where) else np.zeros(0)
        return where, values / np.linalg.norm(values) if len(where) else values

    def nearest(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest that share a term, best first."""
        where, values = self.vector(text)
        if not len(where):
            return where, values
        bound = values @ self.most[where]
        order = np.argsort(-bound, kind="stable")
        first = order[:2]
        cosines = {}

        def score(blocks):
            found = np.tensordot(values, self.weights[where[:, None], blocks], (0, 0)).ravel()
            at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            return at, found

        at, cosines = score(first)
        floor = np.partition(cosines, -self.k)[-self.k] if len(cosines) >= self.k else 0.0
        rest = order[2:]
        rest = rest[bound[rest] >= floor - 1e-9]
        if len(rest):
            more, found = score(rest)
            at, cosines = np.r_[at, more], np.r_[cosines, found]
        keep = cosines > 0
        at, cosines = at[keep], cosines[keep].round(9)
        best = np.lexsort((at, -cosines))[:self.k]
        return at[best], cosines[best]

    def vote(self, text: bytes | None) -> tuple[float | None, np.ndarray]:
        near, cosines = self.nearest(text)
        if not len(near):
            return None, near
        return float((cosines * self.labels[near]).sum() / cosines.sum()), near

    def calibrate(self, rows: list) -> None:
        """Pool adjacent violators: toxic share as a rising function of the vote."""
        votes = [(self.vote(text)[0], y) for _, y, text in rows]
        none = [y for v, y in votes if v is None]
        self.without = sum(none) / len(none) if none else 0.0
        pools: list[list[float]] = []
        for v, y in sorted((v, y) for v, y in votes if v is not None):
            pools.append([v, y, 1])
            while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] == pools[-1][0]):
                v2, y2, n2 = pools.pop()
                pools[-1] = [v2, pools[-1][1] + y2, pools[-1][2] + n2]
        self.steps = (np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools]))

    def score(self, vote: float | None) -> float:
        if vote is None:
            return self.without
        tops, shares = self.steps
        return float(np.interp(vote, tops, shares)) if len(tops) else vote


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, calibration: int = CALIBRATION) -> Index:
    docs = docs.select("doc_id", "text")
    examples, others = sample(docs, labels, per_class, calibration)
    terms = choose_terms(examples)
    index = Index(examples, terms, document_counts(docs, docs.sparkSession.sparkContext.broadcast(frozenset(terms))) if terms else {})
    index.calibrate(others)
    if not terms:
        rows = others or examples
        index.without = sum(y for _, y, _ in rows) / len(rows) if rows else 0.0
    return index


def score(docs: DataFrame, index: Index, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus score, predicted and evidence (ids of the nearest examples, best first)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        model = shared.value

        def compute(batch):
            scores, evidence = [], []
            for text in texts(batch, text_col):
                vote, near = model.vote(text)
                scores.append(model.score(vote))
                evidence.append(model.ids[near[:3]].tolist() if len(near) else [])
            return [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array(evidence, pa.list_(pa.int64()))]

        return compute

    return add_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                              T.StructField("evidence", T.ArrayType(T.LongType()))], make)
