"""Operator 12, cross-tokenizer alignment: which tokens of two vocabularies cover the same text.

Every text, with a space before it, is encoded by a byte-level BPE vocabulary (A)
and a piece vocabulary with byte fallback (B). The byte offsets where tokens of
both end cut it into groups; an A and a B token of one group are linked. An id
pair counts in how many documents it is linked.

Identity-map fast path. ``ident`` maps each A id to the B id of the same bytes,
once. A group of one A and one B token that ``ident`` expects adds to a vector
of the length of vocabulary A; so does such a pair inside a larger group. All other pairs come from
irregular groups, and only they enter the shuffle that counts pairs, once a
block of documents.

Work is shared between equal strings. Before a space that follows a
non-space character both tokenizers always cut, whatever stands around it; so
a text falls into units (a word with the spaces before it, as a rule), a unit is
encoded and aligned once a block of documents, many at a time in arrays, and a document is the
sequence of its units. Tests hold the result against whole-text encodings.

Plan. One pass over the texts writes blocks of about ``BLOCK`` bytes of text: the
units that occur with their pairs, the documents as unit numbers, and the block's distinct
irregular pairs with document counts. Pair counts are summed by pair; each
block asks for the counts of its own pairs by a join on the pair (a pair has one row
a block, so frequent pairs are no hot keys), and the counts return to
their block by its number. Collected and broadcast are two vectors of the length of vocabulary A
(the identity counts, and each A id's highest count) and the vocabulary files.

Edge cases: texts that are null, empty, or not the joined bytes of their tokens
(for example with U+2581 in them) have no tokens, zeros and an empty string for the hash; each row is a
document, also with a null or repeated id; strings of special tokens are plain
text; extra columns are ignored; an empty table gives no rows. Long texts are worked off in
pieces cut between units; a unit is held in memory whole, with its distinct pairs.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import trim_memory, write_table
from .packing import FAST, UNSAFE, Words

BLOCK = 2 << 20
#: Blocks a file: whoever reads or writes a file holds its rows at once.
FILE_BLOCKS = 4
#: Links that are counted at a time.
LINKS = 1 << 18
#: Characters of a text that are cut into units at a time, and units that are aligned at a time.
PIECE = 1 << 20
ALIGNED = 10_000
#: Words whose A ids a worker keeps from one block to the next.
KEPT_WORDS = 30_000
#: A unit begins with a space whose preceding character is no space of any kind.
UNIT = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")
CUT = re.compile(r"(?<=\S) ")


def read_file(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file's bytes, by Spark's reader where the path is no local file."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).head()["content"])


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}


class Links(NamedTuple):
    """Of each unit: whether its bytes come back, (n_a, n_b, groups, links), the hashed string; and
    (unit, A id, times) of identity links, (unit, a << 32 | b, times) of the others."""

    good: np.ndarray
    totals: np.ndarray
    shown: list[bytes]
    same: tuple[np.ndarray, np.ndarray, np.ndarray]
    others: tuple[np.ndarray, np.ndarray, np.ndarray]


def _sum_by(key: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, key, value)
    return out


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row a (unit, link), ordered by both."""
    unit, link, times = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3
    if not len(unit):
        return unit, link, times
    order = np.lexsort((link, unit))
    unit, link, times = unit[order], link[order], times[order]
    start = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (link[1:] != link[:-1])])
    return unit[start], link[start], np.add.reduceat(times, start)


class Aligner:
    """Units of text to tokens, groups and links of both vocabularies."""

    def __init__(self, spec_a: bytes, model_b: bytes):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        spec = json.loads(spec_a)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        words = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.spec_a = spec_a
        self.words = Words(words._encode_single_piece)
        self.bytes_a = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for w, i in ranks.items():
            self.bytes_a[i] = w
        self.b = b = SentencePieceProcessor(model_proto=model_b)
        self.space = b.piece_to_id("▁")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(b.id_to_piece(i) for i in range(b.get_piece_size()))]
        if any(re.search("[^▁]▁", b.id_to_piece(i)) for i in range(len(self.bytes_b))):
            raise ValueError("a piece of vocabulary B spans the end of a word: texts do not fall into units")
        # pieces of whole characters come before single bytes of the same value
        same = {w: i for i, w in enumerate(self.bytes_b) if b.is_byte(i)} | {
            w: i for i, w in reversed(list(enumerate(self.bytes_b))) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))}
        self.ident = np.array([same.get(w, -1) if w else -1 for w in self.bytes_a], np.int64)
        self.len_a, self.len_b = (np.array([len(w) for w in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        top = max(len(self.bytes_a), len(self.bytes_b))
        self.width = np.array([len(str(i)) for i in range(top)], np.int64)
        self.digits = np.zeros((top, len(str(top)) + 1), np.uint8)  # decimal ids, and room for a sign
        for i in range(top):
            self.digits[i, :self.width[i]] = np.frombuffer(str(i).encode(), np.uint8)

    @cached_property
    def whole_a(self):
        """The tokenizer itself, loaded once a text needs it."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(self.spec_a.decode())
        whole.encode_special_tokens = True
        return whole

    def encode(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """(A ids, A tokens of each unit, B ids, B tokens of each unit); B adds the leading space itself."""
        a = [array("I", self.whole_a.encode(u, add_special_tokens=False).ids).tobytes() if UNSAFE.search(u)
             else b"".join(map(self.words.__getitem__, FAST.findall(u))) for u in units]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        b = [x if len(u) > 1 else [self.space] for x, u in zip(b, units, strict=True)]
        return (np.frombuffer(b"".join(a), "<u4").astype(np.int64), np.array([len(x) // 4 for x in a], np.int64),
                np.array([i for x in b for i in x], np.int64), np.array([len(x) for x in b], np.int64))

    def align(self, units: list[str]) -> Links:
        """Groups and links of units that are encoded each for itself, all at once."""
        a, n_a, b, n_b = self.encode(units)
        raw = [u.encode() for u in units]
        size = np.array([len(x) for x in raw], np.int64)
        good = np.ones(len(units), bool)
        for ids, n, table in ((a, n_a, self.bytes_a), (b, n_b, self.bytes_b)):
            words = [table[i] for i in ids.tolist()]
            if b"".join(words) != b"".join(raw):
                end = np.cumsum(n).tolist()
                good &= [b"".join(words[e - m:e]) == x for e, m, x in zip(end, n.tolist(), raw, strict=True)]
        if not good.all():  # only units whose bytes come back have offsets
            a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
            n_a, n_b, size = n_a * good, n_b * good, size * good
        unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        ga, gb = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        first_a, first_b = np.cumsum(ga) - ga, np.cumsum(gb) - gb
        unit_of = unit_a[first_a] if len(common) else np.zeros(0, np.int64)
        # the fast path: one A id and the B id of its bytes
        one = (ga == 1) & (gb == 1)
        one[one] = self.ident[a[first_a[one]]] == b[first_b[one]]
        same = [(unit_of[one], a[first_a[one]], np.ones(int(one.sum()), np.int64))]
        others = []
        # irregular groups: all pairs of small ones, distinct ids with their numbers in large ones
        small = np.flatnonzero(~one & (ga * gb <= 4096))
        for part in np.array_split(small, max(1, int((ga * gb)[small].sum()) // LINKS)):
            n = ga[part] * gb[part]
            nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            each = np.repeat(part, n)
            x, y = a[first_a[each] + nth // gb[each]], b[first_b[each] + nth % gb[each]]
            mine = self.ident[x] == y
            same.append((unit_of[each[mine]], x[mine], np.ones(int(mine.sum()), np.int64)))
            others.append((unit_of[each[~mine]], x[~mine] << 32 | y[~mine], np.ones(int((~mine).sum()), np.int64)))
        for g in np.flatnonzero(~one & (ga * gb > 4096)).tolist():
            x, nx = np.unique(a[first_a[g]:first_a[g] + ga[g]], return_counts=True)
            y, ny = np.unique(b[first_b[g]:first_b[g] + gb[g]], return_counts=True)
            for k in range(len(x)):
                mine = self.ident[x[k]] == y
                for into, which, value in ((same, mine, np.full(len(y), x[k])), (others, ~mine, x[k] << 32 | y)):
                    into.append((np.full(int(which.sum()), unit_of[g]), value[which], (nx[k] * ny)[which]))
        totals = np.stack([n_a, n_b, np.bincount(unit_of, minlength=len(units)), _sum_by(unit_of, ga * gb, len(units))], axis=1)
        return Links(good, totals, self._shown(a, b, group_a, group_b, unit_of, ga, gb, len(units)), _merged(same), _merged(others))

    def _shown(self, a, b, group_a, group_b, unit_of, ga, gb, units) -> list[bytes]:
        """The hashed string of each unit: ids and the sign after each, as rows of characters."""
        ids = np.r_[a, b]
        group = np.r_[group_a, group_b]
        side = np.r_[np.zeros(len(a), np.int8), np.ones(len(b), np.int8)]
        order = np.lexsort((side, group))  # stable: tokens of a side stay in order
        ids, group, side = ids[order], group[order], side[order]
        sign = np.full(len(ids), ord(","), np.uint8)
        upto = np.cumsum(ga + gb)
        sign[upto - gb - 1] = ord("|")
        sign[upto - 1] = ord(";")
        cells = self.digits[ids]
        width = self.width[ids]
        cells[np.arange(len(ids)), width] = sign
        text = cells[np.arange(cells.shape[1]) <= width[:, None]].tobytes()
        end = np.zeros(units, np.int64)
        np.add.at(end, unit_of[group], width + 1)
        end = np.cumsum(end)
        return [text[i:j - 1] if j > i else b"" for i, j in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]

    def forget(self) -> None:
        """A worker serves many tasks: its words stay bounded between blocks."""
        if len(self.words) > KEPT_WORDS:
            self.words = Words(self.words._merge)

    def units(self, text: str):
        """The units of a space and ``text``, a list a piece."""
        text = " " + text
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            yield UNIT.findall(text[at:end])
            at = end


@lru_cache(maxsize=1)
def _aligner(key: str, spec_a: bytes, model_b: bytes) -> Aligner:
    """One per Python worker, which serves many tasks."""
    out = Aligner(spec_a, model_b)
    trim_memory()
    return out


def _forget_aligner() -> None:
    """Workers are kept for later steps, which need no vocabularies."""
    if _aligner.cache_info().currsize:
        _aligner.cache_clear()
        gc.collect()
        trim_memory()


_BLOCK = ("ids binary, known binary, totals binary, hashes binary, codes binary, n_codes binary, "
          "same binary, same_times binary, n_same binary, pair_at binary, pair_times binary, n_pair_at binary, n_units binary, "
          "pairs binary, pair_docs binary, same_docs binary, same_doc_ids binary")
_KINDS = dict(x.split(" ") for x in _BLOCK.split(", "))


def _small(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0).newbyteorder("<")).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_small``."""
    return np.frombuffer(raw, f"<u{len(raw) // n if n else 1}").astype(np.int64)


class Block:
    """Documents as numbers of their units, the units' links, and how many documents hold a pair."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.unit_of: dict[str, int] = {}
        self.ids, self.codes = [], []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        codes, unit_of = array("I"), self.unit_of
        for part in self.aligner.units(text) if text else ():
            codes.extend([unit_of.setdefault(u, len(unit_of)) for u in part])
        self.codes.append(np.frombuffer(codes, np.uint32))
        self.ids.append(doc_id)
        self.size += len(text or "")

    def row(self) -> pa.RecordBatch:
        names = list(self.unit_of)
        good, totals, shown, same_parts, other_parts = [], [], [], [], []
        for base in range(0, len(names), ALIGNED):
            links = self.aligner.align(names[base:base + ALIGNED])
            good.append(links.good)
            totals.append(links.totals)
            shown += links.shown
            same_parts.append((links.same[0] + base, *links.same[1:]))
            other_parts.append((links.others[0] + base, *links.others[1:]))
        self.aligner.forget()
        good = np.concatenate(good) if good else np.zeros(0, bool)
        totals = np.concatenate(totals) if totals else np.zeros((0, 4), np.int64)
        (same_unit, same_flat, same_times), (pair_unit, pair_flat, pair_times) = (
            [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 for parts in (same_parts, other_parts))
        n_same, n_pair = (np.bincount(x, minlength=len(names)) for x in (same_unit, pair_unit))
        self.codes = [c if good[c].all() else c[:0] for c in self.codes]
        n_codes = np.array([len(c) for c in self.codes], np.int64)
        sums = np.array([totals[c].sum(axis=0) for c in self.codes], np.int64).reshape(-1, 4)
        hashes = []
        for c in self.codes:
            h = hashlib.sha256()
            for at in range(0, len(c), 65536):
                h.update((b";" if at else b"") + b";".join(map(shown.__getitem__, c[at:at + 65536].tolist())))
            hashes.append(h.digest())
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        pairs, pair_at = np.unique(pair_flat, return_inverse=True)
        # distinct units of a document, then the distinct pairs of those: how many documents hold each
        doc = np.repeat(np.arange(len(n_codes)), n_codes)
        held = np.unique(doc << 32 | codes.astype(np.int64))
        held_doc, held_unit = held >> 32, held & 0xFFFFFFFF
        counts = []
        for flat, n, width in ((pair_at, n_pair, len(pairs)), (same_flat, n_same, len(self.aligner.bytes_a))):
            total, start = np.zeros(width, np.int64), np.cumsum(n) - n
            each = n[held_unit]
            # whole documents of about LINKS links at a time
            upto = np.cumsum(each)
            lo = 0
            while lo < len(held):
                hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LINKS, "right"))
                hi = int(np.searchsorted(held_doc, held_doc[min(max(hi, lo + 1), len(held)) - 1], "right"))
                m = each[lo:hi]
                at = np.repeat(start[held_unit[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                links = np.unique(np.repeat(held_doc[lo:hi], m) << 32 | flat[at]) & 0xFFFFFFFF
                total += np.bincount(links, minlength=width)
                lo = hi
            counts.append(total)
        same_ids = np.flatnonzero(counts[1])
        values = {
            "ids": np.array([x or 0 for x in self.ids], np.int64), "known": np.array([x is not None for x in self.ids], np.uint8),
            "totals": sums, "hashes": b"".join(hashes), "codes": codes, "n_codes": n_codes.astype(np.uint32),
            "same": same_flat.astype(np.uint32), "same_times": _small(same_times), "n_same": _small(n_same),
            "pair_at": pair_at.astype(np.uint32), "pair_times": _small(pair_times), "n_pair_at": _small(n_pair), "n_units": np.array([len(names)], np.int64),
            "pairs": pairs, "pair_docs": counts[0].astype(np.uint32), "same_docs": counts[1][same_ids].astype(np.uint32), "same_doc_ids": same_ids.astype(np.uint32)}
        return pa.RecordBatch.from_arrays([pa.array([values[c] if isinstance(values[c], bytes) else values[c].tobytes()], pa.binary()) for c in _KINDS], names=list(_KINDS))


def blocks(docs: DataFrame, files) -> DataFrame:
    """Packed blocks of documents; ``files``: the broadcast bytes of both vocabularies."""

    def run(batches):
        spec_a, model_b = files.value
        aligner = _aligner(hashlib.sha256(spec_a + model_b).hexdigest(), spec_a, model_b)
        block = Block(aligner)
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, doc_id in enumerate(ids):
                block.add(doc_id, column[i].as_py())
                if block.size >= BLOCK:
                    yield block.row()
                    block = Block(aligner)
        if block.ids:
            yield block.row()
        del block
        trim_memory()

    return docs.mapInArrow(run, _BLOCK)


def _of(row: pa.RecordBatch | pa.Table, name: str, kind: str, i: int = 0) -> np.ndarray:
    return np.frombuffer(row.column(name)[i].as_py(), kind)


def pair_rows(packed: DataFrame) -> DataFrame:
    """(block, at, pair, n): the irregular pairs of each block and the documents that hold them."""

    def run(batches):
        _forget_aligner()
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                pairs = _of(batch, "pairs", "<i8", i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs), block)), pa.array(np.arange(len(pairs), dtype=np.int32)), pa.array(pairs),
                     pa.array(_of(batch, "pair_docs", "<u4", i).astype(np.int64))], names=["block", "at", "pair", "n"])

    return packed.select("block", "pairs", "pair_docs").mapInArrow(run, "block long, at int, pair long, n long")


def identity_counts(packed: DataFrame, size: int) -> np.ndarray:
    """How many documents link each A id to the B id of its bytes: a vector a task, summed."""

    def run(batches):
        _forget_aligner()
        total = np.zeros(size, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                total[_of(batch, "same_doc_ids", "<u4", i)] += _of(batch, "same_docs", "<u4", i)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["a", "n"])

    out = np.zeros(size, np.int64)
    for r in packed.select("same_doc_ids", "same_docs").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        out[r["a"]] = r["n"]  # at most one row an A id
    return out


_OUT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _finished(vectors):
    """A block and the counts of its pairs to one row a document."""

    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        _forget_aligner()
        cols = [np.zeros(0, np.int64) for _ in range(6)]
        ids, hashes = pa.nulls(0, pa.int64()), pa.nulls(0, pa.string())
        if block.num_rows:
            ident, best = vectors.value
            pairs = _of(block, "pairs", "<i8")
            n = np.zeros(len(pairs), np.int64)
            n[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
            same, pair_at = _of(block, "same", "<u4"), _of(block, "pair_at", "<u4")
            times = np.r_[_numbers(block.column("same_times")[0].as_py(), len(same)), _numbers(block.column("pair_times")[0].as_py(), len(pair_at))]
            count = np.r_[ident[same], n[pair_at]]
            top = np.r_[ident[same] == best[same], (n == best[pairs >> 32])[pair_at]]
            n_units = int(_of(block, "n_units", "<i8")[0])
            n_same, n_pair = (_numbers(block.column(x)[0].as_py(), n_units) for x in ("n_same", "n_pair_at"))
            unit = np.r_[np.repeat(np.arange(len(n_same)), n_same), np.repeat(np.arange(len(n_pair)), n_pair)]
            codes, n_codes = _of(block, "codes", "<u4"), _of(block, "n_codes", "<u4").astype(np.int64)
            sums = []
            for x in (times * top, times * count):
                value = np.zeros(len(n_same), np.int64)
                np.add.at(value, unit, x)
                upto = np.r_[0, np.cumsum(value[codes])]
                end = np.cumsum(n_codes)
                sums.append(upto[end] - upto[end - n_codes])
            cols = [*_of(block, "totals", "<i8").reshape(-1, 4).T, *sums]
            digests = _of(block, "hashes", "u1").reshape(-1, 32)
            hashes = pa.array([d.tobytes().hex() if x else "" for d, x in zip(digests, n_codes.tolist(), strict=True)], pa.string())
            ids = pa.array(_of(block, "ids", "<i8"), mask=_of(block, "known", "u1") == 0)
        return pa.table([ids, *[pa.array(np.ascontiguousarray(c)) for c in cols], hashes], names=[x.split(" ")[0] for x in _OUT.split(", ")])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: tokens of both, groups, links, and what their pairs count corpus-wide."""
    spark = docs.sparkSession
    context = spark.sparkContext
    spec_a, model_b = read_file(spark, path_a), read_file(spark, path_b)
    size = max([*json.loads(spec_a)["model"]["vocab"].values(), *[t["id"] for t in json.loads(spec_a)["added_tokens"]]]) + 1
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = blocks(read, context.broadcast((spec_a, model_b))).withColumn("block", F.monotonically_increasing_id())
    packed = write_table(packed, "aligned-blocks", rows_per_file=FILE_BLOCKS)
    asked = pair_rows(packed)
    counts = write_table(asked.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    ident = identity_counts(packed, size)
    best = ident.copy()
    for r in counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("n")).collect():  # at most one row an A id
        best[r["a"]] = max(best[r["a"]], r["n"])
    found = asked.drop("n").join(counts, "pair").select("block", "at", "n")
    return (packed.groupBy("block").cogroup(found.groupBy("block"))
            .applyInArrow(_finished(context.broadcast((ident, best))), _OUT))
