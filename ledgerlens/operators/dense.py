"""Exact nearest neighbours by squared L2 distance.

A flat exact scan in tiles. The corpus and the questions are packed into blocks
of rows where they lie and written once; every corpus block meets every question
block (a cross join that reads the blocks where they lie: none is shuffled, and
Spark broadcasts a side while it is small). A task holds one tile at a time and
the k nearest so far of its questions: it finds by one matrix product within its
rounding error who can be nearer, computes those distances exactly, and returns
k rows a question, ties to the smaller id. The final rank is a WindowGroupLimit
over them. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lexical import top_k

# Rows of a corpus block and of a question block, at most.
CORPUS_BLOCK = 4096
QUESTION_BLOCK = 1024
DIGITS = 6

#: Vectors that are null or hold null or NaN are nobody's neighbour.
_usable = "vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x))"

_OUT = "question_id long, chunk_id long, dense_distance double"


def _pack(rows: int):
    """Blocks of at most ``rows`` vectors of one length: ids and components as bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, same in pdf.groupby(pdf["vector"].str.len()):
                for a in range(0, len(same), rows):
                    part = same.iloc[a:a + rows]
                    yield pd.DataFrame({"dim": [dim], "ids": [part["id"].to_numpy(np.int64).tobytes()],
                                        "data": [np.stack(part["vector"].to_numpy()).astype(np.float64).tobytes()]})

    return run


class _Asked:
    """A block of questions, and the k nearest rows of each so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.norm = (vectors * vectors).sum(axis=1)
        self.kth = np.full(len(ids), np.inf)
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # question, corpus id, distance

    def add(self, ids: np.ndarray, corpus: np.ndarray) -> None:
        cn = (corpus * corpus).sum(axis=1)
        d = self.norm[:, None] + cn[None, :] - 2.0 * (self.vectors @ corpus.T)
        # what rounding may take from or add to the product form
        slack = (cn.max() + self.norm) * 1e-12 * corpus.shape[1] + 10.0 ** -DIGITS
        limit = self.kth + slack
        if np.isinf(limit).any():
            kk = min(self.k, len(ids))
            limit = np.minimum(limit, np.partition(d, kk - 1, axis=1)[:, kk - 1] + 2 * slack)
        rows, cols = np.nonzero(d <= limit[:, None])
        if not len(rows):
            return
        exact = np.empty(len(rows))
        for a in range(0, len(rows), 1 << 16):
            gap = corpus[cols[a:a + (1 << 16)]] - self.vectors[rows[a:a + (1 << 16)]]
            exact[a:a + (1 << 16)] = (gap * gap).sum(axis=1)
        q, i, e = (np.concatenate(x) for x in zip(self.best, (rows, ids[cols], np.round(exact, DIGITS) + 0.0), strict=True))
        order = np.lexsort((i, e, q))
        q, i, e = q[order], i[order], e[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.best = q[keep], i[keep], e[keep]
        last = place == self.k - 1
        self.kth[q[last]] = e[last]


def _tiles(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: dict[int, _Asked] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                if r.dim != r.question_dim:
                    continue
                if r.number not in met:
                    met[r.number] = _Asked(np.frombuffer(r.question_ids, np.int64),
                                           np.frombuffer(r.question_data).reshape(-1, r.dim), k)
                met[r.number].add(np.frombuffer(r.ids, np.int64), np.frombuffer(r.data).reshape(-1, r.dim))
        for asked in met.values():
            q, i, e = asked.best
            yield pd.DataFrame({"question_id": asked.ids[q], "chunk_id": i, "dense_distance": e})

    return run


def nearest(corpus: DataFrame, questions: DataFrame, k: int = 4,
            corpus_id: str = "chunk_id", corpus_vec: str = "vector",
            question_id: str = "question_id", question_vec: str = "vector") -> DataFrame:
    """J2 + T1: (question_id, chunk_id, dense_distance, dense_rank) for the k
    nearest corpus vectors of every question; rank ties broken by chunk_id.
    Vectors of another length than the question's are not compared with it."""
    c = corpus.select(F.col(corpus_id).cast("long").alias("id"),
                      F.col(corpus_vec).cast("array<double>").alias("vector")).filter(_usable)
    q = questions.select(F.col(question_id).cast("long").alias("id"),
                         F.col(question_vec).cast("array<double>").alias("vector")).filter(_usable)
    packed = "dim long, ids binary, data binary"
    blocks = cut_lineage(c.mapInPandas(_pack(CORPUS_BLOCK), packed), "vector-blocks")
    asked = cut_lineage(q.mapInPandas(_pack(QUESTION_BLOCK), packed)
                        .select(F.monotonically_increasing_id().alias("number"), F.col("dim").alias("question_dim"),
                                F.col("ids").alias("question_ids"), F.col("data").alias("question_data")), "question-blocks")
    tiles = blocks.crossJoin(asked)
    return top_k(tiles.mapInPandas(_tiles(k), _OUT), k, "dense_distance", "dense_rank", ascending=True, digits=DIGITS)
