"""Operator 4, n-gram Jaccard join: size-aware, heavy and light sets apart.

A document's set holds its distinct shingles of ``size`` words (op4: 3). Two sets A, B link when
``100 * |A and B| >= percent * |A or B|``; then each misses at most
``floor(n * (100 - percent) / 100)`` of its n members.

Light sets (size up to a boundary) are joined by fixed-size subsets: every set
enumerates its subsets that leave out at most that many members (two at most,
which bounds the boundary), by key (the
wrapped sum of member hashes, so leaving one out is a subtraction). Linked sets
share the key of their intersection, and sets that share a subset of s members
are linked when ``s`` is large enough for their sizes: no comparison is needed,
and linking every member of a key to its smallest set loses no component.

Heavy sets scan inverted lists. Members are ordered by rarity, and the first
``floor(n * (100 - percent) / 100) + 1`` go into the lists; linked sets meet in one. Lists are cut
by size and position bounds. A list of up to ``SHORT`` sets proposes all its
pairs, a longer one pairs with two hubs. Proposals pass an exact filter (the
parity bitmaps of two sets differ in at most |A xor B| places), then whole sets
are compared, most alike first, and only while the two sides are in different
components. Long lists that still hold several components propose the pairs
between those. So a group of k alike texts costs about k comparisons, and no
link between different components is ever left out.

The boundary is the one of least cost by the histogram of set sizes: subsets
to enumerate against postings, lists and comparisons.

Rarity comes from a counting sketch of fixed size; any order is correct, the
sketch only moves frequent shingles out of the lists. Equal sets are one node,
named by 64 bits: among 1e9 different sets two share a name with a chance of
about 3 %, and would count as equal.

Scale. Whole texts are only read, never shuffled, but for those in proposals.
Sent are packed arrays of 64-bit hashes by hash bucket; buckets follow the
number of input partitions. Broadcasts are of fixed size (the sketch, flagged
hash buckets). Links and components stay tables.

Edge cases: null, empty or blank texts have no shingles, size 0 and their own
id as component; equal texts share a node; rows of one id with different texts
are different nodes; null ids never name a component unless all are null; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, drop_table, n_input_partitions, release_memory, write_table
from .language_id import _joined
from .prefix_free import _MULT, _VALUE, _bucket, _bytes_of, _powers, _runs, slices

SHINGLE = 3
PERCENT = 90
CELLS = 1 << 20
BITS = 512
SHORT = 8
FLAGS = 1 << 20

_LOWER = np.frombuffer(LOWER, np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document, by document and hash."""
    docs = len(offsets) - 1
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return empty
    data = _LOWER[data]
    gap = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(~gap & np.r_[True, gap[:-1] | edge[1:-1]])
    ends = np.flatnonzero(~gap & np.r_[gap[1:] | edge[1:-1], True]) + 1
    if not len(begins):
        return empty
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_MULT, len(data)), out=total[1:])
    word = mix((total[ends] - total[begins]) * _powers(pow(_MULT, -1, 2**64), len(data))[begins] + (ends - begins).astype(np.uint64))
    doc = np.searchsorted(offsets, begins, "right") - 1
    count = np.bincount(doc, minlength=docs)
    first = np.cumsum(count) - count
    # one shingle at each word that has enough words after it; at the first word of a short text
    width = np.minimum(count, size)
    at = np.flatnonzero(np.arange(len(word)) - first[doc] <= (count - width)[doc])
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        there = width[doc[at]] > k
        h[there] = mix(h[there] * np.uint64(_MULT) + word[at[there] + k] + np.uint64(k + 1))
    doc = doc[at]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
    return doc[fresh], h[fresh]


def fingerprints(doc: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two order-free fingerprints) of each document's set."""
    n = np.bincount(doc, minlength=docs)
    f, g = np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)
    if len(doc):
        full = np.flatnonzero(n)
        at = (np.cumsum(n) - n)[full]
        f[full] = np.add.reduceat(h, at)
        g[full] = np.add.reduceat(mix(h + np.uint64(1)), at)
    return n, f, g


def parity_bits(doc: np.ndarray, h: np.ndarray, docs: int, step: int = 512) -> np.ndarray:
    """Packed bitmaps of the documents, ``step`` of them at a time: whether an odd number of members falls on a bit."""
    out = np.zeros((docs, BITS // 8), np.uint8)
    for lo in range(0, docs, step):
        n = min(step, docs - lo)
        a, b = np.searchsorted(doc, (lo, lo + n))
        odd = np.bincount((doc[a:b] - lo) * BITS + (h[a:b] % np.uint64(BITS)).astype(np.int64), minlength=n * BITS) & 1
        out[lo:lo + n] = np.packbits(odd.astype(np.uint8).reshape(n, BITS), axis=1)
    return out


def summaries(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row a document (doc_id, n, f, g, bits, and the columns after the text),
    and per task the sketch's segments (n = -1 - segment, bits: counts)."""
    keys = docs.columns[2:]

    def run(batches):
        names = ["doc_id", "n", "f", "g", "bits", *keys]
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for base, data, offsets in slices(*_joined(batch.column("text"))):
                size = len(offsets) - 1
                doc, h = shingle_sets(data, offsets, width)
                cells += np.bincount((h >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS).astype(np.uint32)
                n, f, g = fingerprints(doc, h, size)
                packed = parity_bits(doc, h, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(base, size), pa.array(n, pa.int64()), pa.array(f.view(np.int64)),
                     pa.array(g.view(np.int64)), pa.array([x.tobytes() for x in packed], pa.binary()),
                     *[batch.column(k).slice(base, size) for k in keys]], names=names)
        if cells.any():
            parts = cells.reshape(64, -1)
            zero = np.zeros(64, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(64, pa.int64()), pa.array(-1 - np.arange(64)), pa.array(zero), pa.array(zero),
                 pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary()),
                 *[pa.nulls(64, pa.int64()) for _ in keys]], names=names)
        release_memory()

    return docs.mapInArrow(run, "doc_id long, n long, f long, g long, bits binary" + "".join(f", {k} long" for k in keys))


def rarity(rows: DataFrame) -> np.ndarray:
    """The sketch as a class for each cell: the bit length of its count (1 MB)."""

    def add(table: pa.Table) -> pa.Table:
        counts = np.zeros(CELLS // 64, np.uint64)
        for x in table.column("bits").to_pylist():
            counts += np.frombuffer(x, "<u4")
        return pa.table({"n": table.column("n").slice(0, 1), "counts": pa.array([counts.astype("<u8").tobytes()], pa.binary())})

    out = np.zeros((64, CELLS // 64), np.uint8)
    # 64 rows of fixed size
    for r in rows.filter("n < 0").select("n", "bits").groupBy("n").applyInArrow(add, "n long, counts binary").collect():
        # classes of a quarter of a power of two
        out[-1 - r["n"]] = np.ceil(4 * np.log2(1 + np.frombuffer(r["counts"], "<u8")))
    return out.ravel()


def subset_counts(n: np.ndarray, percent: int) -> np.ndarray:
    """How many subsets a set of n members enumerates."""
    missing = n * (100 - percent) // 100
    total, term = np.ones(len(n)), np.ones(len(n))
    for k in range(1, int(missing.max(initial=0)) + 1):
        term = term * np.maximum(n - k + 1, 0) / k
        total = total + np.where(k <= missing, term, 0)
    return total


def boundary(sizes: np.ndarray, counts: np.ndarray, percent: int) -> int:
    """The largest light size, of least total cost. A posting costs its list's
    short scan and, at the rate pairs are proposed, comparing members."""
    best, at = np.inf, 0
    subsets = subset_counts(np.minimum(sizes, 40), percent)
    lists = (sizes * (100 - percent) // 100 + 1) * SHORT + sizes / 4
    # sizes whose sets leave out at most two members are enumerated
    for x in (x for x in range(0, 30) if x * (100 - percent) // 100 <= 2):
        light = sizes <= x
        cost = float((counts * np.where(light, subsets, lists)).sum())
        if cost < best:
            best, at = cost, x
    return at


_POSTS = "bucket int, fs binary, ns binary, counts binary, high binary, low binary, place binary"


def postings(docs: DataFrame, order, light: int, percent: int, buckets: int, width: int = SHINGLE) -> DataFrame:
    """Packed by bucket of the key: subset keys of light sets (place = 255 - members
    left out), list entries of heavy sets and of light ones near the boundary
    (place = position, bounded by 200 steps of the prefix)."""
    kinds = [pa.int32(), *[pa.binary()] * 6]
    names = ["bucket", "fs", "ns", "counts", "high", "low", "place"]
    near = percent * (light + 1) // 100

    def run(batches):
        ranks = order.value
        for batch in batches:
            for _, data, offsets in slices(*_joined(batch.column("text"))):
                docs_here = len(offsets) - 1
                doc, h = shingle_sets(data, offsets, width)
                n, f, _ = fingerprints(doc, h, docs_here)
                # equal sets of a slice are sent once
                _, one = np.unique(f, return_index=True)
                chosen = np.zeros(docs_here, bool)
                chosen[one] = True
                own = chosen[doc]
                doc, h = doc[own], h[own]
                keys, whose, places = [], [], []
                is_light = n[doc] <= light
                # light: the whole set, then one or two members left out
                whole = np.flatnonzero(chosen & (n > 0) & (n <= light))
                keys.append(f[whole])
                whose.append(whole)
                places.append(np.zeros(len(whole), np.int64))
                one_out = is_light & (n[doc] * (100 - percent) // 100 >= 1)
                keys.append(f[doc[one_out]] - h[one_out])
                whose.append(doc[one_out])
                places.append(np.ones(one_out.sum(), np.int64))
                for x in np.flatnonzero(chosen & (n <= light) & (n * (100 - percent) // 100 >= 2)):
                    own = h[doc == x]
                    i, j = np.triu_indices(len(own), 1)
                    keys.append(f[x] - own[i] - own[j])
                    whose.append(np.full(len(i), x))
                    places.append(np.full(len(i), 2))
                k1 = mix(np.concatenate(keys))
                w1, p1 = np.concatenate(whose).astype(np.int64), np.concatenate(places)
                # heavy: the rarest members
                by = np.flatnonzero(n[doc] >= max(1, near))
                cls = ranks[(h[by] >> np.uint64(40)).astype(np.int64) % CELLS]
                sort = by[np.lexsort((h[by], cls, doc[by]))]
                d2 = doc[sort]
                edge = _runs(d2)
                pos = np.arange(len(d2)) - np.repeat(edge[:-1], np.diff(edge)) if len(d2) else np.zeros(0, np.int64)
                pre = pos <= n[d2] * (100 - percent) // 100
                k2, w2, p2 = h[sort][pre], d2[pre], pos[pre] + 3
                key, who, place = np.r_[k1, k2], np.r_[w1, w2], np.r_[p1, p2]
                bucket = _bucket(key, buckets)
                o = np.lexsort((who, bucket))
                key, who, place, bucket = key[o], who[o], place[o], bucket[o]
                rows, cut = [], _runs(bucket)
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    of = _runs(who[a:b])
                    sets = who[a:b][of[:-1]]
                    rows.append((int(bucket[a]), f[sets].astype("<u8").tobytes(), n[sets].astype("<u4").tobytes(), np.diff(of).astype("<u4").tobytes(),
                                 (key[a:b] >> np.uint64(32)).astype("<u4").tobytes(), (key[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                                 place[a:b].astype("<u4").tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        release_memory()

    return docs.select("text").mapInArrow(run, _POSTS)


def proposals(posts: DataFrame, percent: int) -> DataFrame:
    """kind 0: linked pairs (a, b) of light sets; 1: pairs to compare; 2: an
    entry of a long list (a: set, b: list, n, place)."""

    def run(table: pa.Table) -> pa.Table:
        counts = _bytes_of(table.column("counts"), "<u4")
        f = np.repeat(_bytes_of(table.column("fs"), "<u8"), counts)
        n = np.repeat(_bytes_of(table.column("ns"), "<u4").astype(np.int64), counts)
        key = _bytes_of(table.column("high"), "<u4").astype(np.uint64) << np.uint64(32) | _bytes_of(table.column("low"), "<u4")
        place = _bytes_of(table.column("place"), "<u4").astype(np.int64)
        subset = place < 3
        kinds, left, right, size, at = [], [], [], [], []

        def emit(kind, a, b, x=None, y=None):
            swap = (a > b) if kind < 2 else np.zeros(len(a), bool)
            left.append(np.where(swap, b, a))
            right.append(np.where(swap, a, b))
            kinds.append(np.full(len(a), kind, np.int32))
            size.append(np.zeros(len(a), np.int64) if x is None else x)
            at.append(np.zeros(len(a), np.int64) if y is None else y)

        # subsets: the set with the fewest members left out is the key's centre
        p = np.flatnonzero(subset)
        p = p[np.lexsort((f[p], place[p], key[p]))]
        edge = _runs(key[p])
        if len(p):
            centre = np.repeat(p[edge[:-1]], np.diff(edge))
            s = n[p] - place[p]
            link = (f[p] != f[centre]) & (100 * s >= percent * (s + place[p] + place[centre]))
            emit(0, f[p][link], f[centre][link])
        # lists, each set once
        p = np.flatnonzero(~subset)
        p = p[np.lexsort((f[p], key[p]))]
        if len(p):
            p = p[np.r_[True, (key[p[1:]] != key[p[:-1]]) | (f[p[1:]] != f[p[:-1]])]]
            edge = _runs(key[p])
            length = np.repeat(np.diff(edge), np.diff(edge))
            rank = np.arange(len(p)) - np.repeat(edge[:-1], np.diff(edge))
            reach = n - (place - 3)

            def fits(a, b):
                need = -(-percent * (n[a] + n[b]) // (100 + percent))
                return (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (np.minimum(reach[a], reach[b]) >= need)

            for step in range(1, SHORT):
                i = np.flatnonzero((length <= SHORT) & (rank + step < length))
                a, b = p[i], p[i + step]
                ok = fits(a, b)
                emit(1, f[a][ok], f[b][ok])
            long = np.flatnonzero(length > SHORT)
            if len(long):
                q = p[long]
                # hubs: the set of least hash under one hash for all lists and under one of four;
                # lists of the same group choose the same few hubs
                for h in (mix(f[q]), mix(f[q] + (key[q] & np.uint64(3)) * np.uint64(_MULT) + np.uint64(1))):
                    o = np.lexsort((h, key[q]))
                    e = _runs(key[q][o])
                    hub = np.repeat(q[o][e[:-1]], np.diff(e))
                    a = q[o]
                    ok = (a != hub) & fits(a, hub)
                    emit(1, f[a][ok], f[hub][ok])
                emit(2, f[q], key[q], n[q], place[q] - 3)
        cols = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((kinds, np.int32), (left, np.uint64), (right, np.uint64), (size, np.int64), (at, np.int64))]
        keep = np.ones(len(cols[0]), bool)
        if len(keep):
            o = np.lexsort((cols[2], cols[1], cols[0]))
            keep = np.r_[True, (np.diff(cols[0][o]) != 0) | (cols[1][o][1:] != cols[1][o][:-1]) | (cols[2][o][1:] != cols[2][o][:-1])]
            cols = [c[o][keep] for c in cols]
        return pa.table({"kind": cols[0], "a": cols[1].view(np.int64), "b": cols[2].view(np.int64), "n": cols[3], "place": cols[4]})

    return posts.groupBy("bucket").applyInArrow(run, "kind int, a long, b long, n long, place long")


def _is_star_forest(pairs: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: each component is a star around its smallest node."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("root"))
    return seen.filter("ups > 1 or (ups = 1 and root = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of (a, b) by large and small stars,
    until the edges are a star forest."""
    pairs = write_table(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), "edges")
    while not _is_star_forest(pairs):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        new = write_table(small, "edges")
        drop_table(pairs)
        pairs = new
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _compare(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""

    def run(batches):
        for batch in batches:
            keep = []
            left, right = _joined(batch.column("ta")), _joined(batch.column("tb"))
            for i in range(batch.num_rows):
                x, y = (shingle_sets(d[o[i]:o[i + 1]], np.array([0, o[i + 1] - o[i]]), width)[1] for d, o in (left, right))
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release_memory()

    joined = (pairs.join(texts.select(F.col("f").alias("a"), F.col("text").alias("ta")), "a")
              .join(texts.select(F.col("f").alias("b"), F.col("text").alias("tb")), "b"))
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _texts_of(docs: DataFrame, flags, width: int) -> DataFrame:
    """(f, text) of the sets whose hash bucket is flagged."""

    def run(batches):
        wanted = flags.value
        for batch in batches:
            for base, data, offsets in slices(*_joined(batch.column("text"))):
                _, f, _ = fingerprints(*shingle_sets(data, offsets, width), len(offsets) - 1)
                _, one = np.unique(f, return_index=True)
                one = one[np.isin((f[one] >> np.uint64(44)).astype(np.int64), wanted)]
                yield pa.RecordBatch.from_arrays([pa.array(f[one].view(np.int64)), batch.column("text").take(pa.array(base + one))], names=["f", "text"])
        release_memory()

    return docs.select("text").mapInArrow(run, "f long, text string").groupBy("f").agg(F.min("text").alias("text"))


def _across(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs whose sides are in different components so far."""
    if roots is None:
        return pairs
    out = pairs
    for side in ("a", "b"):
        named = roots.select(F.col("node").alias(side), F.col("root").alias("r" + side))
        out = out.join(named, side, "left").withColumn("r" + side, F.coalesce("r" + side, side))
    return out.filter("ra <> rb").drop("ra", "rb")


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the exact bitmap filter, with the number of differing bits."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("f").alias(side), F.col("n").alias("n" + side), F.col("bits").alias("x" + side)), side)

    def run(batches):
        ones = np.array([bin(i).count("1") for i in range(256)], np.int64)
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("xa", "xb"))
            apart = ones[x ^ y].sum(axis=1)
            # |A xor B| <= (100 - percent) / (100 + percent) * (|A| + |B|)
            ok = apart * (100 + percent) <= (100 - percent) * n
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(apart, pa.int64())], names=["a", "b", "apart"]).filter(pa.array(ok))
        release_memory()

    return pairs.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long, apart long")


def _with_words(rows: DataFrame) -> DataFrame:
    """The bitmap as long columns x0, x1, ..., so that a join condition can compare two."""
    words = BITS // 64

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("bits").to_pylist()), "<i8").reshape(-1, words)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(words)]],
                                             names=[*batch.schema.names[:-1], *[f"x{i}" for i in range(words)]])

    kept = rows.select("f", "key", "n", "place", "root", "bits")
    return kept.mapInArrow(run, "f long, key long, n long, place long, root long, " + ", ".join(f"x{i} long" for i in range(words)))


def _settle(links: DataFrame, wanted: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, width: int, roots: DataFrame | None):
    """Compare the wanted pairs until none across components is left: (links, roots)."""
    left = write_table(_alike(_across(wanted, roots), sets, percent), "wanted")
    flags = [r[0] for r in left.select(F.explode(F.array("a", "b")).alias("f"))
             .select(F.shiftrightunsigned("f", 44).alias("x")).distinct().collect()]  # at most FLAGS small integers
    if not flags:
        return links, components(links) if roots is None else roots
    texts = write_table(_texts_of(docs, docs.sparkSession.sparkContext.broadcast(np.array(flags, np.int64)), width), "wanted-texts")
    # the most alike pair of each set first, then what is still across components
    best = Window.partitionBy("a").orderBy("apart", "b")
    batch = write_table(left.withColumn("i", F.row_number().over(best)), "batch")
    for first in (True, False):
        now = batch.filter("i = 1") if first else write_table(_across(batch.filter("i > 1"), roots), "wanted")
        if not first and now.isEmpty():
            break
        links = links.unionByName(write_table(_compare(now.select("a", "b"), texts, percent, width), "links"))
        roots = components(links)
    drop_table(left)
    drop_table(batch)
    drop_table(texts)
    return links, roots


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE,
         keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row; shingles of ``size`` words.

    With ``keys``, columns of 64-bit integers that tell rows apart, also these and
    ``root``, which names a row's component whatever its ids (null: no shingles)."""
    spark = docs.sparkSession
    buckets = 2 * n_input_partitions(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keys)
    seen = write_table(summaries(rows, size), "sets")
    order = spark.sparkContext.broadcast(rarity(seen))
    seen = seen.filter("n >= 0")
    sets = seen.filter("n > 0").groupBy("f").agg(F.min("n").alias("n"), F.min("doc_id").alias("least"), F.min("bits").alias("bits"))
    # one row for each size up to 30, and one for the rest
    sizes = sets.groupBy(F.least("n", F.lit(31)).alias("n")).count().collect()
    light = boundary(np.array([r["n"] for r in sizes], np.int64), np.array([r["count"] for r in sizes], np.float64), percent) if sizes else 0
    found = write_table(proposals(postings(rows, order, light, percent, buckets, size), percent), "proposals")
    links = found.filter("kind = 0").select("a", "b")
    links, roots = _settle(links, found.filter("kind = 1").select("a", "b").distinct(), rows, sets, percent, size, None)
    # long lists that still hold several components: the pairs between them
    long = found.filter("kind = 2").select(F.col("a").alias("f"), F.col("b").alias("key"), "n", "place")
    long = long.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    mixed = long.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    open_lists = write_table(_with_words(long.join(mixed, "key").join(sets.select("f", "bits"), "f")), "lists")
    if not open_lists.isEmpty():
        # texts that share only a rare passage: bounds on size and place, then the bitmap, cut the pairs
        a, b = open_lists.alias("a"), open_lists.alias("b")
        fits = (f"a.key = b.key AND a.f < b.f AND a.root <> b.root AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) "
                f"AND least(a.n - a.place, b.n - b.place) * {100 + percent} >= {percent} * (a.n + b.n) "
                f"AND ({' + '.join(f'bit_count(a.x{i} ^ b.x{i})' for i in range(BITS // 64))}) * {100 + percent} <= {100 - percent} * (a.n + b.n)")
        more = a.join(b, F.expr(fits)).select(F.col("a.f").alias("a"), F.col("b.f").alias("b")).distinct()
        links, roots = _settle(links, more, rows, sets, percent, size, roots)
    named = sets.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    ids = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("f", "component_id", "root")
    return (seen.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("f")).alias("f"), *keys)
            .join(ids, "f", "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    *keys, *(["root"] if keys else [])))
