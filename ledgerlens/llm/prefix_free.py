"""Operator 10, suffix-array dedup of byte strings by prefix-free parsing.

Every byte covered by a ``length``-byte string that also starts in a document
with a smaller id is removed; all judgements are made on the input.

Method. A rolling hash runs over all ``TRIGGER``-byte strings. The trigger of a
``length``-byte window is its leftmost string of least hash, so equal windows
have equal triggers at equal offsets, and the windows that share one trigger
form a phrase (the text from the first of them to the end of the last). Each
window lies in exactly one phrase. The parse is the list of a document's
phrases; the dictionary holds the distinct ones.

1. Triggers met in only one document cannot belong to a repeated window. Their
   hashes are dealt into buckets, each bucket keeps those of two or more
   documents.
2. Phrases of the kept triggers are dealt by trigger. A bucket builds its
   dictionary, sorts the dictionary's suffixes by their first ``length`` bytes
   (windows are equal only within a bucket and as far before their trigger, as
   equal windows share the trigger and its place, so suffixes are sorted one
   place at a time) and takes each distinct window's smallest document.
3. Through the parse, windows whose smallest document is not their own give
   spans to remove; a document's spans are merged over its text.

Hashes only propose; windows are compared byte by byte, so results are exact.

Scale. What is shuffled are packed arrays: about 7 bytes a trigger (one byte in
fourteen has one), and the phrases of repeated triggers. A text that cannot
hold a repeated trigger never moves (a table of at most 2**20 flagged id hashes
is broadcast). Buckets follow the number of input partitions. A trigger is the
least of its window, so the high bits of its hash are small: names and buckets
are made of the other bits, which are even. A trigger that many documents of one
slice share is settled there and sends two entries; a phrase that a smaller
document of the slice holds too is settled there as a span. Settled rows go to
any bucket, so a passage held by a third of all documents does not fill one.

Edge cases: a null text is empty (no bytes, nothing removed); texts shorter
than ``length`` bytes keep everything; rows of one id never remove each other
and each gets its own row; a null id sorts after all others; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, n_input_partitions, trim_memory, write_table
from .language_id import _joined

LENGTH = 50
TRIGGER = 24
SLICE = 1 << 20
FLAG_BUCKETS = 1 << 20
PART = 1 << 20
LAST = 2**63 - 1

_MULT = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def rolling_hash(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed 64-bit hash of every ``size``-byte string of ``data``."""
    n = len(data) - size + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_MULT, len(data)), out=total[1:])
    h = (total[size:] - total[:n]) * _powers(pow(_MULT, -1, 2**64), n)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def phrases(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER):
    """(hash of the trigger, trigger position, first window, last window, document) of every phrase."""
    none = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return none.astype(np.uint64), none, none, none, none
    h = rolling_hash(data, trigger)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    # the hash's high bits, then the position: the minimum is the leftmost least
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span, step = length - trigger + 1, 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[:len(low) - (span - step)], low[span - step:])
    full = sizes >= length
    mark = np.zeros(len(data) + 1, np.int32)
    mark[offsets[:-1][full]] += 1
    mark[offsets[1:][full] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(mark[:len(low)]))
    at = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes))[full], sizes[full] - length + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return h[at[first]], at[first], starts[first], starts[last], doc[first]


def slices(data: np.ndarray, offsets: np.ndarray):
    """Runs of whole documents of about SLICE bytes: (first document, data, offsets)."""
    doc = 0
    while doc < len(offsets) - 1:
        end = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + SLICE, "right")) - 1)
        yield doc, data[offsets[doc]:offsets[end]], offsets[doc:end + 1] - offsets[doc]
        doc = end


def _names(h: np.ndarray) -> np.ndarray:
    """Trigger hashes without their 16 highest bits, which are small in the least of a window."""
    return h << np.uint64(16)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)] if len(keys) else np.zeros(1, np.int64)


def _any_bucket(names: np.ndarray, d: np.ndarray, buckets: int) -> int:
    """A bucket for rows that fit into any."""
    return int(_bucket(np.bitwise_xor.reduce((names ^ d.view(np.uint64)) * np.uint64(_MULT), keepdims=True), buckets)[0])


def _packed_ids(d: np.ndarray) -> bytes:
    """Differences of ordered ids, bytes of one place together: nearly all are zero."""
    return np.diff(d, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked_ids(column) -> np.ndarray:
    parts = [np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel()) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


_PARTS = "bucket int, settled boolean, docs binary, high binary, low binary"


def _trigger_parts(docs: DataFrame, buckets: int, length: int, trigger: int) -> DataFrame:
    """Step 1, before the shuffle: distinct (document, trigger name), packed by bucket."""
    names = ["bucket", "settled", "docs", "high", "low"]
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 3]

    def run(batches):
        for batch in batches:
            ids = batch.column("d").to_numpy()
            for base, data, offsets in slices(*_joined(batch.column("text"))):
                h, _, _, _, doc = phrases(data, offsets, length, trigger)
                if not len(h):
                    continue
                h, d = _names(h), ids[base + doc]
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                fresh = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
                h, d = h[fresh], d[fresh]
                edge = _runs(h)
                # two documents are proof enough; what the slice itself has settled only passes through
                settled = np.arange(len(h)) - np.repeat(edge[:-1], np.diff(edge)) >= 2
                bucket = _bucket(h, buckets)
                bucket[settled] = -1
                order = np.lexsort((d, bucket))
                cut, rows = _runs(bucket[order]), []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    p = order[a:b]
                    done = bool(settled[p[0]])
                    rows.append((_any_bucket(h[p], d[p], buckets) if done else int(bucket[p[0]]), done, _packed_ids(d[p]),
                                 (h[p] >> np.uint64(32)).astype("<u4").tobytes(), (h[p] >> np.uint64(16)).astype("<u2").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        trim_memory()

    return docs.select("d", "text").mapInArrow(run, _PARTS)


def _bytes_of(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _split_settled(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Rows that ask, and rows that are settled."""
    settled = table.column("settled")
    return table.filter(pc.invert(settled)), table.filter(settled)


def repeated_triggers(docs: DataFrame, buckets: int, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """(d, h): the trigger names of each document that two or more documents have."""

    def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h = _bytes_of(table.column("high"), "<u4").astype(np.uint64)
        h <<= np.uint64(16)
        h |= _bytes_of(table.column("low"), "<u2")
        h <<= np.uint64(16)
        return _unpacked_ids(table.column("docs")), h.view(np.int64)

    def run(table: pa.Table) -> pa.Table:
        asked, settled = _split_settled(table)
        d, h = unpacked(asked)
        order = np.argsort(h)
        d, h = d[order], h[order]
        edge = _runs(h)
        if not len(h):
            keep = np.zeros(0, bool)
        else:
            several = np.minimum.reduceat(d, edge[:-1]) != np.maximum.reduceat(d, edge[:-1])
            keep = np.repeat(several, np.diff(edge))
        out = pa.table({x: pa.chunked_array([pa.array(y[keep]), pa.array(z)]) for x, y, z in zip(("d", "h"), (d, h), unpacked(settled), strict=True)})
        trim_memory()
        return out

    return _trigger_parts(docs, buckets, length, trigger).groupBy("bucket").applyInArrow(run, "d long, h long")


def _entries(extra: np.ndarray, shift: np.ndarray, body: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """One phrase of each kind, and the kind of each phrase."""
    # padded to one width, with size and trigger place as part of the key
    wide = int(extra.max()) + length
    key = np.zeros((len(extra), wide + 2), np.uint8)
    for column in range(wide):
        has = np.flatnonzero(extra + length > column)
        key[has, column] = body[begin[has] + column]
    key[:, wide], key[:, wide + 1] = extra, shift
    _, one, entry = np.unique(key.view(f"V{wide + 2}").ravel(), return_index=True, return_inverse=True)
    return one, entry


def _settled_phrases(names: np.ndarray, d: np.ndarray, extra: np.ndarray, shift: np.ndarray, body: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """Which phrases a document with a smaller id holds too, as a whole."""
    out = np.zeros(len(names), bool)
    order = np.argsort(names, kind="stable")
    edge = _runs(names[order])
    if not len(names):
        return out
    several = np.minimum.reduceat(d[order], edge[:-1]) != np.maximum.reduceat(d[order], edge[:-1])
    p = order[np.repeat(several, np.diff(edge))]
    if len(p):
        one, entry = _entries(extra[p], shift[p], body, begin[p], length)
        least = np.full(len(one), LAST, np.int64)
        np.minimum.at(least, entry, d[p])
        out[p] = least[entry] < d[p]
    return out


def _phrase_parts(docs: DataFrame, buckets: int, length: int, trigger: int) -> DataFrame:
    """Step 2, before the shuffle: the phrases whose trigger is in ``hs``, packed by bucket, and the spans that the slice has settled."""
    names = ["bucket", "settled", "docs", "keys", "start", "end", "shift", "extra", "body"]
    kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 7]

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("d").to_numpy(), batch.column("k").to_numpy()
            known = batch.column("hs")
            for base, data, offsets in slices(*_joined(batch.column("text"))):
                h, at, first, last, doc = phrases(data, offsets, length, trigger)
                h = _names(h)
                # a name kept for one document of the slice is repeated, whichever document has it
                wanted = np.flatnonzero(np.isin(h.view(np.int64), known.slice(base, len(offsets) - 1).flatten().to_numpy()))
                h, at, first, last, doc = (x[wanted] for x in (h, at, first, last, doc))
                d, k, extra, shift = ids[base + doc], keys[base + doc], last - first, at - first
                start, end = first - offsets[doc], last + length - offsets[doc]
                settled = _settled_phrases(h, d, extra, shift, data, first, length)
                rows, p = [], np.flatnonzero(settled)
                if len(p):
                    # spans that touch become one; they are in order of document and place
                    new = np.flatnonzero(np.r_[True, (doc[p[1:]] != doc[p[:-1]]) | (start[p[1:]] > end[p[:-1]])])
                    to = p[np.r_[new[1:], len(p)] - 1]
                    p = p[new]
                    rows.append((_any_bucket(h[p], d[p], buckets), True, _packed_ids(d[p]), k[p].astype("<i8").tobytes(),
                                 start[p].astype("<u4").tobytes(), end[to].astype("<u4").tobytes(), b"", b"", b""))
                asked = np.flatnonzero(~settled)
                bucket = _bucket(h[asked], buckets)
                order = np.argsort(bucket, kind="stable")
                bucket, order = bucket[order], asked[order]
                cut, raw = _runs(bucket), data.tobytes()
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    p = order[a:b]
                    rows.append((int(bucket[a]), False, _packed_ids(d[p]), k[p].astype("<i8").tobytes(), start[p].astype("<u4").tobytes(), b"",
                                 shift[p].astype("<u1").tobytes(), extra[p].astype("<u1").tobytes(),
                                 zlib.compress(b"".join(raw[x:y + length] for x, y in zip(first[p].tolist(), last[p].tolist(), strict=True)), 1)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        trim_memory()

    return docs.select("d", "k", "text", "hs").mapInArrow(
        run, "bucket int, settled boolean, docs binary, keys binary, start binary, end binary, shift binary, extra binary, body binary")


def _spans_of(d: np.ndarray, start: np.ndarray, shift: np.ndarray, extra: np.ndarray, body: np.ndarray,
              begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, end) of the removable runs of windows of some phrases."""
    # the dictionary: distinct phrases with their smallest documents
    one, entry = _entries(extra, shift, body, begin, length)
    least = np.full(len(one), LAST, np.int64)
    np.minimum.at(least, entry, d)
    view = np.lib.stride_tricks.sliding_window_view(body, length)
    n = extra + 1
    base = np.cumsum(n) - n
    gone = np.zeros(int(n.sum()), bool)
    for back in range(int(shift.max()) + 1):
        # its suffixes that begin so far before the trigger, in order of their first ``length`` bytes
        j = shift[one] - back
        has = np.flatnonzero((j >= 0) & (j <= extra[one]))
        if not len(has):
            continue
        windows = np.ascontiguousarray(view[begin[one[has]] + j[has]]).view(f"V{length}").ravel()
        _, same = np.unique(windows, return_inverse=True)
        smallest = np.full(int(same.max()) + 1, LAST, np.int64)
        np.minimum.at(smallest, same, least[has])
        source = np.full(len(one), LAST, np.int64)
        source[has] = smallest[same]
        # the parse: each occurrence looks up its phrase's window
        j = shift - back
        own = np.flatnonzero((j >= 0) & (j <= extra))
        gone[base[own] + j[own]] = source[entry[own]] < d[own]
    before, after = np.r_[False, gone[:-1]], np.r_[gone[1:], False]
    before[base] = False
    after[base + n - 1] = False
    new, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    who = np.searchsorted(base, new, "right") - 1
    return who, start[who] + new - base[who], start[who] + end - base[who] + length


def removable_spans(docs: DataFrame, buckets: int, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """(d, k, start, end): spans of windows whose smallest document is not their own."""

    def run(table: pa.Table) -> pa.Table:
        table, settled = _split_settled(table)
        found = [(_unpacked_ids(settled.column("docs")), _bytes_of(settled.column("keys"), "<i8"),
                  *(_bytes_of(settled.column(x), "<u4").astype(np.int64) for x in ("start", "end")))]
        d, k = _unpacked_ids(table.column("docs")), _bytes_of(table.column("keys"), "<i8")
        start = _bytes_of(table.column("start"), "<u4").astype(np.int64)
        shift, extra = (_bytes_of(table.column(x), "u1").astype(np.int64) for x in ("shift", "extra"))
        body = np.frombuffer(b"".join(map(zlib.decompress, table.column("body").to_pylist())), np.uint8)
        del table, settled
        if len(d):
            begin = np.cumsum(extra + length) - (extra + length)
            # phrases of one trigger stay together in parts of about PART bytes, one after the other
            wide = min(8, trigger)
            words = np.zeros((len(d), 8), np.uint8)
            words[:, :wide] = np.lib.stride_tricks.sliding_window_view(body, wide)[begin + shift + (trigger - wide) // 2]
            mixed = words.view("<u8").ravel() * np.uint64(_MULT)
            part = _bucket(mixed, -(-len(body) // PART))
            order = np.argsort(part, kind="stable")
            cut = _runs(part[order])
            del words, mixed, part
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                p = order[a:b]
                who, first, last = _spans_of(d[p], start[p], shift[p], extra[p], body, begin[p], length)
                found.append((d[p[who]], k[p[who]], first, last))
        out = pa.table({name: np.concatenate([x[i] for x in found]) for i, name in enumerate(("d", "k", "start", "end"))})
        trim_memory()
        return out

    return _phrase_parts(docs, buckets, length, trigger).groupBy("bucket").applyInArrow(run, "d long, k long, start long, end long")


def _cut(docs: DataFrame, with_kept: bool) -> DataFrame:
    def make():
        def compute(batch):
            data, offsets = _joined(batch.column("text"))
            sizes, removed, runs, digests, left = [], [], [], [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                own = data[offsets[i]:offsets[i + 1]]
                if spans:
                    mark = np.zeros(len(own) + 1, np.int32)
                    np.add.at(mark, [s["start"] for s in spans], 1)
                    np.add.at(mark, [s["end"] for s in spans], -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    own = own[~gone]
                else:
                    runs.append(0)
                sizes.append(int(offsets[i + 1] - offsets[i]))
                removed.append(sizes[-1] - len(own))
                raw = own.tobytes()
                digests.append(hashlib.sha256(raw).hexdigest())
                left.append(raw if with_kept else None)
            return [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                    pa.array(digests, pa.string()), pa.array(left, pa.binary())]

        return compute

    return add_columns(docs, [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                              T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                              T.StructField("kept", T.BinaryType())], make)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
          trigger: int = TRIGGER, with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is what is
    left, as bytes (a cut may fall inside a character); null if not asked for."""
    buckets = n_input_partitions(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"))
    rows = rows.withColumn("k", F.xxhash64("doc_id", "text")).withColumn("flag", F.pmod(F.xxhash64("d"), F.lit(FLAG_BUCKETS)))
    found = write_table(repeated_triggers(rows, 2 * buckets, length, trigger)
                        .groupBy("d").agg(F.collect_set("h").alias("hs")), "triggers")
    # at most FLAG_BUCKETS rows
    flags = F.broadcast(found.select(F.pmod(F.xxhash64("d"), F.lit(FLAG_BUCKETS)).alias("flag")).distinct())
    moved = rows.join(flags, "flag", "left_semi")
    spans = write_table(removable_spans(moved.join(found, "d"), 2 * buckets, length, trigger)
                        .groupBy("d", "k").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    still = rows.join(flags, "flag", "left_anti")
    kept = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = still.select("doc_id", F.octet_length(kept).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                         F.lit(0).cast("long").alias("n_spans"), F.sha2(kept, 256).alias("kept_sha256"), (kept if with_kept else F.lit(None).cast("binary")).alias("kept"))
    cut = _cut(moved.join(spans, ["d", "k"], "left").select("doc_id", "text", "spans"), with_kept)
    return whole.unionByName(cut.select(*whole.columns))
