"""Operator 5, exact top-k search: an impact-ordered, score-at-a-time index.

Vectors become integers (``floor(scale * x)``), scores are integer inner
products. Every block of ``block_rows`` candidate rows is indexed by dimension:
postings sorted by value, cut into segments of equal quantised impact
(``impact`` values wide). For a query, the segments of all dimensions are taken
in descending order of ``|weight| * quantised |value|``, one band of impacts at
a time. After a band, a dimension whose segments below ``cut`` are open can
still move a row by at most ``|weight| * cut``, so each row has a proven lower
and upper score. The k-th best lower bound (or the k-th best score known from
earlier blocks) is the threshold; processing stops once few rows can still
reach it, and exactly those are rescored from the whole vector. A row equal to
the threshold is kept, so ties are decided by the smaller id.

Scale. Queries are collected and broadcast in blocks of ``query_block`` rows (a
proven bound), each against all rows in one narrow scan; a task keeps k rows a
query over all its blocks, and only those are shuffled.

Edge cases: vectors that are null, or hold null or non-finite components, take
no part, nor do rows without an id; vectors of different lengths are compared
as if the shorter one ended in zeros; rows that share an id are
candidates and queries each, and none of them is a candidate of its own id's queries; components whose
products could leave 64 bits raise an error; fewer than k candidates give fewer ranks; no queries or an
empty table give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

SCALE = 256
IMPACT = 8
BLOCK_ROWS = 16_384
QUERY_BLOCK = 32_768
#: Shares of the largest impact down to which the bands reach; the last takes all.
BANDS = (0.12, 0.04, 0.0)


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """Rows x dimensions, floor(scale * x); clean vectors only."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max()) if len(lengths) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths),
        np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.clip(
            np.floor(scale * flat), -2.0**62, 2.0**62)
    return out


def fitted(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows[:, :width]


class ImpactIndex:
    """Postings of one block: for each dimension the rows in order of value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.ascontiguousarray(np.sort(rows, axis=0).T)
        self.largest = np.abs(rows).max(axis=0, initial=0)

    def possible(self, query: np.ndarray, k: int, threshold: float, few: int) -> np.ndarray:
        """Positions of the rows that can be among the k best: all others are
        proven to score below ``threshold`` or below k rows of this block."""
        n, impact = len(self.ids), np.abs(query) * self.largest
        dims, top = np.flatnonzero(impact), float(impact.max(initial=0))
        left, right = dict.fromkeys(dims, 0), dict.fromkeys(dims, n)
        score, met, cuts_met = np.zeros(n), [], []
        for band in BANDS:
            opened, weights, cut = [], [], {}
            for d in dims:
                weight, values = float(query[d]), self.values[d]
                # segments are IMPACT values wide; those from ``cut`` outwards are taken
                cut[d] = int(band * top / abs(weight)) // IMPACT * IMPACT
                a = int(np.searchsorted(values, -cut[d], "right")) if cut[d] else n
                b = max(a, int(np.searchsorted(values, cut[d], "left"))) if cut[d] else n
                for lo, hi in ((left[d], min(a, right[d])), (max(b, left[d]), right[d])):
                    if lo < hi:
                        opened.append(self.order[d, lo:hi])
                        weights.append(values[lo:hi] * weight)
                        cuts_met.append(d)
                left[d], right[d] = a, b
            if opened:
                score += np.bincount(np.concatenate(opened), np.concatenate(weights), n)
                met += opened
            # a row not yet met in a dimension moves by less than weight * cut there
            reach = {d: abs(float(query[d])) * cut[d] for d in dims}
            rest = np.full(n, sum(reach.values()))
            if band and met:
                rest -= np.bincount(np.concatenate(met), np.repeat([reach[d] for d in cuts_met], [len(x) for x in met]), n)
            rest = np.maximum(rest, 0) if band else np.zeros(n)
            if n > k:
                threshold = max(threshold, float(np.partition(score - rest, n - k)[n - k]))
            keep = np.flatnonzero(score + rest >= threshold)
            if len(keep) <= few:
                break
        return keep


class Best:
    """The k best (score, id) of every query so far; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def threshold(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        first = np.lexsort((ids, -scores))[:self.k]
        self.ids[q], self.scores[q] = ids[first], scores[first]


def search_block(best: Best, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
    """Fold one block of candidates into ``best``."""
    width = max(rows.shape[1], queries.shape[1])
    rows, queries = fitted(rows, width), fitted(queries, width)
    index = ImpactIndex(ids, rows)
    few = max(4 * k, len(ids) // 64)
    largest = [int(np.abs(x).max(initial=0)) for x in (rows, queries)]
    if width * largest[0] * largest[1] >= 2**63:
        raise ValueError("inner products of these vectors can leave 64 bits")
    in_order = np.sort(ids)
    own = np.searchsorted(in_order, query_ids, "right") - np.searchsorted(in_order, query_ids, "left")
    for q in range(len(query_ids)):
        # rows of the query's own id do not count
        keep = index.possible(queries[q], min(k + int(own[q]), len(ids)), best.threshold(q), few)
        keep = keep[ids[keep] != query_ids[q]]
        best.add(q, ids[keep], rows[keep] @ queries[q])


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows with usable vectors."""
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & usable))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that ``is_query`` (a column over ``id``) selects."""
    spark = vectors.sparkSession
    rows = write_table(clean(vectors, id_col, vector_col), "vectors")
    asked = rows.filter(is_query)
    blocks = max(1, -(-asked.count() // query_block))
    found = None
    for b in range(blocks):
        got = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        query_ids = got.column("id").to_numpy()
        block = spark.sparkContext.broadcast((query_ids, integers(got.column("v"), scale)))

        def run(batches, block=block):
            query_ids, queries = block.value
            best, held, n = Best(len(query_ids), k), [], 0
            if not len(query_ids):
                return

            def fold():
                rows = [integers(x.column("v"), scale) for x in held]
                width = max(x.shape[1] for x in rows)
                ids = np.concatenate([x.column("id").to_numpy() for x in held])
                search_block(best, ids, np.concatenate([fitted(x, width) for x in rows]), query_ids, queries, k)

            for batch in batches:
                for lo in range(0, batch.num_rows, block_rows):
                    held.append(batch.slice(lo, block_rows))
                    n += held[-1].num_rows
                    if n >= block_rows:
                        fold()
                        held, n = [], 0
            if held:
                fold()
            ids, scores = np.concatenate(best.ids), np.concatenate(best.scores)
            of = np.repeat(query_ids, [len(x) for x in best.ids])
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(ids), pa.array(scores)],
                                             names=["query_id", "vec_id", "score"])

        part = rows.mapInArrow(run, "query_id long, vec_id long, score long")
        if blocks > 1:
            part = write_table(part, "topk-block")
        found = part if found is None else found.unionByName(part)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
