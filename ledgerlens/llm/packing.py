"""Operator 8, best-fit packing: bins of token pieces by swap-based local search.

Tokens. A text is cut by the vocabulary's own pre-tokenizer rule and every word
is looked up in a bounded cache of word -> id bytes; unknown words are merged
with the ranks of the same vocabulary file. A document's ids are the joined
bytes, so lengths and checksums need no Python integers. Texts with characters
for which the two regex engines differ go through the tokenizer itself.

Pieces. The document's ids and the end id; only documents longer than a bin are
cut: a first piece of the remainder, then full ones.

Packing. Full pieces fill a bin each. The others are dealt at random (a hash of
document and piece) into groups of about ``group_rows`` rows, and every group
packs itself: best fit decreasing first, then local search between underfull
bins: moving a piece, or swapping one for one or two for one, whenever that
raises the sum of squared fills, until a bin empties or nothing rises. Bins
left under 98 % are dissolved and packed again in a next round with the other
groups' ones, until one group is left or the rounds stop helping. Groups are
bounded by rows, not by a key, so no text or source can skew them; text never
leaves the first scan.

Edge cases: a null or empty text is the end id alone, one piece of length 1;
repeated documents are packed each; an empty table gives no rows; null ids
stay null; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

SIZE = 1024
END_ID = 2
GROUP_ROWS = 20_000
CACHE_WORDS = 200_000
#: Bins filled to this share are not packed again in a later round.
CLOSE = 0.98
#: The pre-tokenizer's rule, written for the characters that UNSAFE leaves.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ \t-\r0-9{LETTERS}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
UNSAFE = re.compile(r"[\x1c-\x1f\x85\xa0\xb2\xb3\xb9\xbc-\xbeɐ-\U0010ffff]|<\|")


class Words(dict):
    """word -> id bytes in two bounded generations, so that frequent words stay."""

    def __init__(self, merge):
        super().__init__()
        self._merge, self._old = merge, {}

    def __missing__(self, word: str) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            ids = array("I", self._merge(word)).tobytes()
        if len(self) >= CACHE_WORDS:
            self._old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Tokens:
    """text -> little-endian ids, as bytes."""

    def __init__(self, path: str, end_id: int = END_ID):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        words = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._whole = Tokenizer.from_file(path)
        self._words = Words(words._encode_single_piece)
        self.end = array("I", [end_id]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if UNSAFE.search(text):
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        return b"".join(map(self._words.__getitem__, FAST.findall(text))) + self.end


@lru_cache(maxsize=2)
def tokens_of(path: str, end_id: int) -> Tokens:
    """One per Python worker, which serves many tasks."""
    return Tokens(path, end_id)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
           end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and copy: a number that tells repeated rows apart."""

    def run(batches):
        tokens = tokens_of(path, end_id)
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], [], []]
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for doc, text, copy in rows:
                ids = tokens.encode(text)
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for k in range(len(cuts) - 1):
                    part = ids[4 * cuts[k]:4 * cuts[k + 1]]
                    for column, value in zip(out, (doc, k, cuts[k], len(part) // 4, zlib.crc32(part), copy), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "copy"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                        F.monotonically_increasing_id().alias("copy"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"))


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of positions, best fit decreasing."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            b, left = len(bins), size
            bins.append([i])
        if left > n:
            insort(room, (left - n, b))
    return bins


def _shift(own: list[tuple[int, int]], theirs: list[tuple[int, int]], room: int) -> tuple[int, list[int], list[int]]:
    """The largest shift of at most ``room`` tokens out of a bin: one or two of
    its pieces against none or one of the other's. (0, [], []) if there is none."""
    sums = {n: [x] for n, x in own}
    for i, (n, x) in enumerate(own):
        for n2, x2 in own[:i]:
            sums.setdefault(n + n2, [x, x2])
    back = dict(theirs)
    sizes = sorted({0, *back})
    best: tuple[int, list[int], list[int]] = (0, [], [])
    for n, out in sums.items():
        at = bisect_left(sizes, max(0, n - room))
        if at < len(sizes) and best[0] < n - sizes[at] <= room:
            m = sizes[at]
            best = (n - m, out, [back[m]] if m else [])
    return best


def local_search(lengths: np.ndarray, bins: list[list[int]], size: int) -> list[list[int]]:
    """Moves and swaps between underfull bins that raise the sum of squared
    fills; bins that empty are dropped.

    The emptiest bin is the source. With a >= b the fills of another bin and of
    the source, shifting d > 0 tokens to the other changes the sum by
    2 * d * (a - b + d) > 0. When the room of all other bins is less than what
    the source holds, no bin can be emptied any more and the search ends.
    """
    fill = [int(lengths[b].sum()) for b in bins]
    targets = sorted((i for i in range(len(bins)) if fill[i] < size), key=lambda i: (-fill[i], i))
    while targets:
        source = targets.pop()
        if sum(size - fill[i] for i in targets) < fill[source]:
            break
        moved = True
        while bins[source] and moved:
            moved = False
            for target in targets:
                room = size - fill[target]
                if not room or not bins[source]:
                    continue
                shift, out, back = _shift([(int(lengths[x]), x) for x in bins[source]],
                                          [(int(lengths[x]), x) for x in bins[target]], room)
                if shift:
                    bins[source] = [x for x in bins[source] if x not in out] + back
                    bins[target] = [x for x in bins[target] if x not in back] + out
                    fill[source] -= shift
                    fill[target] += shift
                    moved = True
        targets = [i for i in targets if fill[i] < size]
    return [b for b in bins if b]


def _packed(rows: DataFrame, groups: int, size: int) -> DataFrame:
    """Every group packed by itself: its bins, the offsets and the bins' fills."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), table.column("copy").to_numpy(), lengths))
        table, lengths = table.take(order), lengths[order]
        bins = local_search(lengths, best_fit(lengths, size), size)
        bin_of, offset, full = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for k, members in enumerate(bins):
            bin_of[members] = k
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
            full[members] = lengths[members].sum()
        for name, values in (("bin", bin_of), ("offset", offset), ("fill", full)):
            table = table.append_column(name, pa.array(values))
        return table

    kept = rows.select("doc_id", "piece", "start", "length", "ids_crc32", "copy")
    dealt = kept.withColumn("grp", F.pmod(F.xxhash64("copy", "piece", F.lit(groups)), F.lit(groups)))
    return dealt.groupBy("grp").applyInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, copy long, grp long, bin long, offset long, fill long")


def pack(parts: DataFrame, size: int = SIZE, group_rows: int = GROUP_ROWS, close: float = CLOSE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset). Sequences of
    one full piece have even numbers, packed ones odd numbers."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = write_table(parts, "pieces")
    out = (rows.filter(F.col("length") == size)
           .select(*columns, (F.monotonically_increasing_id() * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    left = rows.filter(F.col("length") < size)
    n, turn, last = left.count(), 0, False
    while not last:
        groups = max(1, -(-n // group_rows))
        packed = write_table(_packed(left, groups, size), "packed")
        # 24 bits for the group, 16 for its bins: a group has at most a few times group_rows rows
        number = ((F.lit(turn) * 2**24 + F.col("grp")) * 2**16 + F.col("bin")) * 2 + 1
        left = packed.filter(F.col("fill") < close * size)
        before, n, turn = n, left.count(), turn + 1
        last = groups == 1 or n == 0 or n > 0.7 * before
        closed = packed if last else packed.filter(F.col("fill") >= close * size)
        out = out.unionByName(closed.select(*columns, number.alias("sequence_id"), "offset"))
    return out
