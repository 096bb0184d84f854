"""Operator 13, approximate nearest neighbours: NN-descent graph, greedy graph search.

``nodes``: each distinct vector is one node with the smallest ids of its copies,
so copies need no links. ``build``: every node starts with the best of some
leaves (nodes sorted by the signs of random projections, cut into runs of
``LEAF``); then rounds of NN-descent: a node's neighbours and a sample of its reverse
neighbours meet at it, each pair of which at least one is new is compared, and a
pair goes to the node that it would improve. Rounds end when few neighbours
change. ``search``: every query keeps a beam of its best nodes; the best
unopened ones are opened, their neighbours fetched by a join and compared,
until the beam holds no unopened node. Results are scored in double precision on the original vectors.

Quality. The graph's degree, the beam and the leaves are parameters of an
approximate index, not limits on the data: every row is in the graph, and ids of copies are
returned exactly. Recall is measured against brute force in the tests and stated in the README.

Scale. Sent in a round are one row a neighbour, with the unit vector in half
precision; a hub sends ``REVERSE`` reverse neighbours at most (cut inside tasks by a
window's group limit). Leaves and runs of a node are cut from sorted partitions, so no
group is collected whole. Nothing but ``ENTRIES`` entry vectors, the mean
vector and counters passes through the driver.

Edge cases: null ids, and vectors that are null, empty, zero or hold null or
non-finite components take no part; shorter vectors count as padded with zeros;
rows of one id are one candidate and one query, at their best score; equal
rows count once; fewer candidates than k give fewer rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, write_table

DEGREE = 40
REVERSE = 24
LEAF = 512
TREES = 8
ROUNDS = 6
#: Rounds end when fewer than this share of all neighbours is new.
STILL = 0.05
BEAM = 128
OPENED = 32
HOPS = 16
ENTRIES = 256


def matrix(column: pa.Array, kind: str = "<f8", width: int = 0) -> np.ndarray:
    """Packed vectors as rows, padded with zeros to the widest."""
    raw = column.to_pylist()
    size = np.dtype(kind).itemsize
    lengths = {len(x) for x in raw}
    width = max([width, *[n // size for n in lengths]]) if raw else width
    if len(lengths) == 1 and lengths == {width * size}:
        return np.frombuffer(b"".join(raw), kind).reshape(-1, width)
    out = np.zeros((len(raw), width), kind)
    for i, x in enumerate(raw):
        out[i, :len(x) // size] = np.frombuffer(x, kind)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors, also of components whose squares leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision on the given vectors."""
    with np.errstate(all="ignore"):
        out = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    bad = np.flatnonzero(~np.isfinite(out))
    if len(bad):
        out[bad] = (unit(x[bad]) * unit(y[bad])).sum(axis=1)
    return out


def runs_kept_whole(batches, key: str):
    """Tables of sorted rows that never split a run of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last == 0 and held and held[-1].column(key)[-1].as_py() == keys[0]:
            held.append(batch)
            continue
        if held:
            first = int(np.searchsorted(keys, held[-1].column(key)[-1].as_py(), "right"))
            if first:
                held.append(batch.slice(0, first))
            yield pa.Table.from_batches(held)
            held = []
            batch, last = batch.slice(first), last - first
        if last > 0:
            yield pa.Table.from_batches([batch.slice(0, last)])
            batch = batch.slice(last)
        if batch.num_rows:
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def packed(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows that take part, vectors as bytes of doubles."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column("id"), batch.column("v")
            values = column.flatten()
            good = ids.is_valid().to_numpy(zero_copy_only=False) & column.is_valid().to_numpy(zero_copy_only=False)
            sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy().astype(np.int64)
            end = np.cumsum(sizes)
            x = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
            at = np.flatnonzero(good & (sizes > 0))
            fine = [i for i in at.tolist() if np.isfinite(y := x[end[i] - sizes[i]:end[i]]).all() and y.any()]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(fine, pa.int64())), pa.array([x[end[i] - sizes[i]:end[i]].astype("<f8").tobytes() for i in fine], pa.binary())],
                                             names=["id", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(T.ArrayType(T.DoubleType())).alias("v"))
    return rows.mapInArrow(run, "id long, vec binary")


def nodes(rows: DataFrame, copies: int) -> DataFrame:
    """(node, vec, half, ids): distinct vectors, their unit vectors in half precision, and
    the ``copies`` smallest ids of each."""

    def halves(batches):
        for batch in batches:
            half = unit(matrix(batch.column("vec"))).astype("<f2") if batch.num_rows else np.zeros((0, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h.tobytes() for h in half], pa.binary())], names=[*batch.schema.names, "half"])

    nth = Window.partitionBy("vec").orderBy("id")
    first = (rows.withColumn("nth", F.dense_rank().over(nth)).filter(F.col("nth") <= copies)
             .groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")))  # at most ``copies`` ids
    return write_table(first.mapInArrow(halves, "vec binary, ids array<bigint>, half binary")
                       .withColumn("node", F.monotonically_increasing_id()), "nn-nodes")


def mean_vector(points: DataFrame) -> np.ndarray:
    """The mean of the unit vectors (one row a component)."""

    def run(batches):
        total, n = np.zeros(0), 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("half"), "<f2", len(total)).astype(np.float64)
                total = np.pad(total, (0, x.shape[1] - len(total))) + x.sum(axis=0)
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], names=["at", "x", "n"])

    found = points.select("half").mapInArrow(run, "at long, x double, n long").groupBy("at").agg(F.sum("x").alias("x"), F.max("n")).collect()
    out = np.zeros(max([r["at"] + 1 for r in found], default=0))
    for r in found:
        out[r["at"]] = r["x"]
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


_EDGE = "node long, nbr long, sim float"


def _edge_batch(node, nbr, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(nbr.astype(np.int64)), pa.array(sim.astype(np.float32))], names=["node", "nbr", "sim"])


def leaves(points: DataFrame, mean: np.ndarray, seed: int, leaf: int, degree: int) -> DataFrame:
    """Edges between nodes of a leaf: runs of nodes sorted by the signs of random projections."""
    signs = np.random.default_rng(seed).standard_normal((max(1, len(mean)), 48))
    signs -= np.outer(mean, mean @ signs) if len(mean) else 0  # planes through the mean direction cut evenly
    bit = 1 << np.arange(47, -1, -1)

    def keyed(batches):
        for batch in batches:
            x = matrix(batch.column("half"), "<f2", len(mean)).astype(np.float32)
            key = (x @ signs.astype(np.float32) > 0) @ bit if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.astype(np.int64))], names=[*batch.schema.names, "key"])

    def compared(batches):
        def edges(ids, x):
            g = np.einsum("gid,gjd->gij", x, x, optimize=True) if len(x) > 1 else (x[0] @ x[0].T)[None]
            m = g.shape[1]
            g[:, np.arange(m), np.arange(m)] = -np.inf
            top = min(degree, m - 1)
            if top < 1:
                return None
            at = np.argpartition(-g, top - 1, axis=2)[:, :, :top]
            sim = np.take_along_axis(g, at, axis=2)
            nbr = np.take_along_axis(np.broadcast_to(ids[:, None, :], g.shape), at, axis=2)
            return _edge_batch(np.repeat(ids.ravel(), top), nbr.ravel(), sim.ravel())

        ids, x = np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = matrix(batch.column("half"), "<f2", len(mean)).astype(np.float32)
            ids = np.r_[ids, batch.column("node").to_numpy()]
            x = new if x is None else np.concatenate([x, new])
            # whole leaves, eight at a time; what is left waits for the next batch
            while len(ids) >= leaf:
                n = min(len(ids) // leaf, 8) * leaf
                yield edges(ids[:n].reshape(-1, leaf), x[:n].reshape(-1, leaf, x.shape[1]))
                ids, x = ids[n:], x[n:]
        if len(ids) > 1:
            yield edges(ids[None], x[None])

    sorted_rows = points.select("node", "half").mapInArrow(keyed, "node long, half binary, key long").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return sorted_rows.select("node", "half").mapInArrow(compared, _EDGE)


def best(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best distinct neighbours of each node; a neighbour is fresh if all its rows are."""
    merged = edges.repartition("node").groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    return merged.withColumn("i", rank).filter(F.col("i") <= degree).drop("i")


def _local_join(batches):
    """Runs of (at, node, fresh, worst, half): improving pairs among the members of each run."""
    for table in runs_kept_whole(batches, "at"):
        table = table.combine_chunks()
        at = table.column("at").to_numpy()
        who = table.column("node").to_numpy()
        o = np.lexsort((~table.column("fresh").to_numpy(), who, at))
        keep = o[np.r_[True, (at[o][1:] != at[o][:-1]) | (who[o][1:] != who[o][:-1])]]
        at, who = at[keep], who[keep]
        fresh, worst = table.column("fresh").to_numpy()[keep], table.column("worst").to_numpy()[keep]
        x = matrix(table.column("half").chunk(0).take(pa.array(keep)), "<f2").astype(np.float32)
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        size = np.diff(np.r_[start, len(at)])
        for lo in range(0, len(start), 256):
            s, n = start[lo:lo + 256], size[lo:lo + 256]
            m = int(n.max())
            place = np.minimum(s[:, None] + np.arange(m), len(at) - 1)
            there = np.arange(m) < n[:, None]
            y = x[place]
            g = y @ y.transpose(0, 2, 1)
            f = fresh[place]
            ok = there[:, :, None] & there[:, None, :] & (f[:, :, None] | f[:, None, :]) & (g > worst[place][:, :, None])
            ok[:, np.arange(m), np.arange(m)] = False
            group, i, j = np.nonzero(ok)
            node, nbr, sim = who[place[group, i]], who[place[group, j]], g[group, i, j]
            o = np.lexsort((nbr, node))
            o = o[np.r_[True, (node[o][1:] != node[o][:-1]) | (nbr[o][1:] != nbr[o][:-1])]] if len(o) else o
            yield _edge_batch(node[o], nbr[o], sim[o])


def build(points: DataFrame, degree: int = DEGREE, reverse: int = REVERSE, leaf: int = LEAF, trees: int = TREES, rounds: int = ROUNDS) -> DataFrame:
    """(node, nbr, sim, fresh): the neighbour graph of all nodes."""
    mean = mean_vector(points)
    # the leaves together offer more than a node keeps: half the degree from each is enough
    first = leaves(points, mean, 0, leaf, -(-degree // 2))
    for seed in range(1, trees):
        first = first.unionByName(leaves(points, mean, seed, leaf, -(-degree // 2)))
    graph = write_table(best(first.withColumn("fresh", F.lit(True)), degree), "nn-graph")
    for step in range(rounds):
        back = graph.select(F.col("nbr").alias("at"), F.col("node"), "fresh")
        back = back.withColumn("i", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("fresh"), F.xxhash64("at", "node", F.lit(step)))))
        members = graph.select(F.col("node").alias("at"), F.col("nbr").alias("node"), "fresh").unionByName(back.filter(F.col("i") <= reverse).drop("i"))
        # only where something new meets
        lively = graph.filter("fresh").select(F.explode(F.array("node", "nbr")).alias("at")).distinct()
        worst = graph.groupBy("node").agg(F.when(F.count("*") >= degree, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
        known = points.select("node", "half").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
        met = members.join(lively, "at", "left_semi").join(known, "node").select("at", "node", "fresh", "worst", "half")
        pairs = met.repartition("at").sortWithinPartitions("at").mapInArrow(_local_join, _EDGE)
        new = write_table(best(pairs.withColumn("fresh", F.lit(True)).unionByName(graph.withColumn("fresh", F.lit(False))), degree), "nn-graph")
        drop_table(graph)
        graph = new
        changed = graph.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).first()
        if changed["fresh"] <= STILL * changed["n"]:
            break
    return graph


_BEAM = "q long, node long, sim float, open boolean, asked boolean"


def _advance(beam: int, opened: int):
    """Runs of a query's rows: kind 0 its own vector, 1 its beam, 2 nodes to compare. Returns the
    new beam; the best unopened nodes are asked for and count as opened from then on."""

    def run(batches):
        for table in runs_kept_whole(batches, "q"):
            table = table.combine_chunks()
            q, kind, node = (table.column(c).to_numpy() for c in ("q", "kind", "node"))
            sim, open_ = table.column("sim").to_numpy().copy(), table.column("open").to_numpy().copy()
            new = np.flatnonzero(kind == 2)
            own = np.flatnonzero(kind == 0)
            half = table.column("half").chunk(0)
            if len(new):
                mine = own[np.searchsorted(q[own], q[new])]
                x, y = (matrix(half.take(pa.array(i)), "<f2").astype(np.float32) for i in (mine, new))
                w = max(x.shape[1], y.shape[1])
                sim[new] = (np.pad(x, ((0, 0), (0, w - x.shape[1]))) * np.pad(y, ((0, 0), (0, w - y.shape[1])))).sum(axis=1)
            open_[new] = True
            rest = np.flatnonzero(kind > 0)
            # one row a node: beam rows first, as they know whether the node was opened
            o = rest[np.lexsort((kind[rest], node[rest], q[rest]))]
            o = o[np.r_[True, (q[o][1:] != q[o][:-1]) | (node[o][1:] != node[o][:-1])]] if len(o) else o
            o = o[np.lexsort((node[o], -sim[o], q[o]))]
            start = np.searchsorted(q[o], q[o], "left")
            o = o[np.arange(len(o)) - start < beam]
            waits = open_[o]
            before = np.cumsum(waits) - waits
            first = np.searchsorted(q[o], q[o], "left")
            asked = waits & (before - before[first] < opened) if len(o) else waits
            yield pa.RecordBatch.from_arrays([pa.array(q[o]), pa.array(node[o]), pa.array(sim[o]), pa.array(waits & ~asked), pa.array(asked)],
                                             names=["q", "node", "sim", "open", "asked"])

    return run


def search(targets: DataFrame, points: DataFrame, graph: DataFrame, beam: int = BEAM, opened: int = OPENED, hops: int = HOPS) -> DataFrame:
    """(q, node, sim): the beam of each query of ``targets`` (q, half, start: a node to begin at, or null)."""
    spark = targets.sparkSession
    entries = points.orderBy(F.xxhash64("node")).limit(ENTRIES).select("node", "half").collect()  # ENTRIES rows
    if not entries:
        return spark.createDataFrame([], "q long, node long, sim float")
    names = np.array([r["node"] for r in entries], np.int64)
    x = matrix(pa.array([bytes(r["half"]) for r in entries], pa.binary()), "<f2").astype(np.float32)

    def begin(batches):
        for batch in batches:
            if batch.num_rows:
                y = matrix(batch.column("half"), "<f2", x.shape[1]).astype(np.float32)
                g = y @ np.pad(x, ((0, 0), (0, y.shape[1] - x.shape[1]))).T
                at = np.argpartition(-g, min(4, len(names)) - 1, axis=1)[:, :4]
                yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(np.repeat(np.arange(len(g)), at.shape[1]))), pa.array(names[at].ravel())], names=["q", "node"])

    ask = targets.select("q", "half").mapInArrow(begin, "q long, node long").unionByName(targets.filter("start IS NOT NULL").select("q", F.col("start").alias("node")))
    null_half = F.lit(None).cast("binary").alias("half")
    own = targets.select("q", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("node"), F.lit(0.0).cast("float").alias("sim"), F.lit(False).alias("open"), "half")
    state = None
    for _ in range(hops):
        fresh = (ask.distinct().join(points.select("node", "half"), "node")
                 .select("q", F.lit(2).alias("kind"), "node", F.lit(0.0).cast("float").alias("sim"), F.lit(True).alias("open"), "half"))
        rows = own.unionByName(fresh)
        if state is not None:
            rows = rows.unionByName(state.select("q", F.lit(1).alias("kind"), "node", "sim", "open", null_half))
        new = write_table(rows.repartition("q").sortWithinPartitions("q").mapInArrow(_advance(beam, opened), _BEAM), "nn-beam")
        if state is not None:
            drop_table(state)
        state = new
        asked = state.filter("asked")
        if asked.isEmpty():
            break
        ask = asked.select("q", "node").join(graph.select("node", "nbr"), "node").select("q", F.col("nbr").alias("node"))
    return state.select("q", "node", "sim")


def _scored(batches):
    for batch in batches:
        if batch.num_rows:
            x, y = matrix(batch.column("qvec")), matrix(batch.column("vec"))
            w = max(x.shape[1], y.shape[1])
            score = cosine(np.pad(x, ((0, 0), (0, w - x.shape[1]))), np.pad(y, ((0, 0), (0, w - y.shape[1]))))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("ids"), pa.array(score)], names=["q", "ids", "score"])


def neighbours(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query``, a
    condition on ``id``, holds; the query's own id is no candidate."""
    rows = write_table(packed(vectors, id_col, vec_col), "nn-rows")
    points = nodes(rows, k + 1)
    graph = build(points)
    asks = write_table(rows.filter(is_query).distinct().join(points.select("vec", F.col("node").alias("q")), "vec").select(F.col("id").alias("query_id"), "q"), "nn-queries")
    targets = write_table(asks.select("q").distinct().join(points.select(F.col("node").alias("q"), "half"), "q").withColumn("start", F.col("q")), "nn-targets")
    found = search(targets, points, graph)
    # half precision can swap near ties: twice as many as needed are scored on the original vectors
    near = Window.partitionBy("q").orderBy(F.desc("sim"), "node")
    chosen = found.withColumn("i", F.row_number().over(near)).filter(F.col("i") <= 2 * k + 2).select("q", "node")
    pairs = (chosen.join(points.select("node", "vec", "ids"), "node")
             .join(points.select(F.col("node").alias("q"), F.col("vec").alias("qvec")), "q").select("q", "qvec", "vec", "ids"))
    ids = (pairs.mapInArrow(_scored, "q long, ids array<bigint>, score double").select("q", "score", F.explode("ids").alias("vec_id"))
           .groupBy("q", "vec_id").agg(F.max("score").alias("score")))
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= k + 1).drop("i")
    mine = (asks.join(ids, "q").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
