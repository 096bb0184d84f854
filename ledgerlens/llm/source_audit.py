"""Operator 11, source divergence audit: term shares of sources against each other.

A term is a run of letters and non-ASCII bytes, A-Z lower-cased. A language
keeps the terms that at least ``MIN_DOCS`` of its documents hold. A group is a
(lang, source) that occurs; its share of a kept term is
``p = 1 + floor(10**9 * (count + 1) / (N + V))`` (N: all its counts, V: kept terms),
and two shares differ by ``floor((p - q)**2 / q)``. ``audit`` returns how far
each source is from each other one of its language (part ``pair``) and which
terms put it above its language (part ``term``, the ``TOP`` first).

Counting, by length-bucketed packing. Inside a task terms of up to 8 bytes
become one uint64 word and those of up to 16 bytes two, big-endian, so integers
sort as bytes do; each class is ordered by a radix sort of 16-bit digits and
counted by runs (the sort is stable, so a term's documents stay together and
are counted too). Longer terms go into buckets by the next power of two of
their length, sorted as byte strings. A task merges its runs and sends one row
a (lang, source, term) and flush, as two integers and, for long terms only, a string.

Scale. One shuffle of those rows by (lang, term): no key is larger than the
number of sources and tasks. Shares of all pairs of sources are summed by
buckets of terms and tiles of about ``TILE`` x ``TILE`` sources: what a term
adds to a pair where neither source has it is the same for all terms, so only
occurring counts are touched. Nothing is broadcast but what Spark finds small.

Arithmetic is exact: shares by decimals, squares below 2**63, sums below
``(10**9 + V)**2``, which fits 64 bits up to V = 2 * 10**9 (more raises an error).

Edge cases: null text, lang and source read as ''; groups without terms take
part with count 0 everywhere; without kept terms every pair has value 0; each
row is a document, also if its id is null or repeated; one language with one
source has no pairs; extra columns are ignored; an empty table gives no rows.
Texts longer than ``PIECE`` are counted in pieces cut between terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table
from .language_id import _joined

MIN_DOCS = 3
TOP = 200
TILE = 200
#: Bytes that are cut into terms at a time, and runs a task holds before it sends them.
PIECE = 1 << 22
HELD = 1 << 19
#: Entries of a bucket of terms, at least.
ENTRIES = 1 << 14
#: Longer terms are held as Python strings of bytes instead of rows of a matrix.
WIDEST = 1024

_FOLD = np.array([(c + 32) if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
_KEEP = np.array([(1 << 64) - (1 << 8 * (8 - k)) for k in range(9)], np.uint64)
_SIGN = np.uint64(1 << 63)


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(first document, folded bytes, offsets, whole): runs of documents of about
    PIECE bytes; a longer document alone, in parts (whole is False) cut at separators."""
    doc, docs = 0, len(offsets) - 1
    while doc < docs:
        end = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + PIECE, "right")) - 1)
        a, b = int(offsets[doc]), int(offsets[end])
        if b - a <= PIECE:
            yield doc, _FOLD[data[a:b]], offsets[doc:end + 1] - a, True
        while b - a > PIECE:  # one document: up to the first separator after PIECE bytes
            cut, gap = a + PIECE, np.zeros(0, np.int64)
            while cut < b and not len(gap):
                gap = np.flatnonzero(_FOLD[data[cut:min(b, cut + 65536)]] == 0)
                cut = cut + int(gap[0]) if len(gap) else min(b, cut + 65536)
            yield doc, _FOLD[data[a:cut]], np.array([0, cut - a]), False
            a = cut
            if b - a <= PIECE:
                yield doc, _FOLD[data[a:b]], np.array([0, b - a]), False
        doc = end


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """The stable order by uint64 keys, the last key first in rank: 16-bit digits, least significant first."""
    order = np.arange(len(digits[0]))
    for key in digits:
        spread = np.bitwise_or.reduce(key ^ key[0]) if len(key) else 0
        for shift in range(0, 64, 16):
            if int(spread) >> shift & 0xFFFF:
                order = order[np.argsort((key[order] >> np.uint64(shift)).astype(np.uint16), kind="stable")]
    return order


class Runs:
    """Counts of (group, term) as arrays: short terms by two words, long ones also by their bytes."""

    def __init__(self):
        self.short: list[tuple[np.ndarray, ...]] = []
        self.long: list[tuple[int, bytes, int, int]] = []
        self.held = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> None:
        """Count the terms of folded ``data``; ``group``: the group of each document."""
        inside = data != 0
        if not inside.any():
            return
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = np.flatnonzero(inside & np.r_[True, ~inside[:-1] | edge[1:-1]])
        size = np.flatnonzero(inside & np.r_[~inside[1:] | edge[1:-1], True]) + 1 - begins
        doc = np.searchsorted(offsets, begins, "right") - 1
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        word = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
        for lo, hi in ((1, 8), (9, 16)):
            at = np.flatnonzero((size >= lo) & (size <= hi))
            if not len(at):
                continue
            first = word[begins[at]].astype(np.uint64) & _KEEP[np.minimum(size[at], 8)]
            second = word[begins[at] + 8].astype(np.uint64) & _KEEP[size[at] - 8] if hi > 8 else np.zeros(len(at), np.uint64)
            d = doc[at]
            g = group[d].astype(np.uint64)
            o = radix_order([second, first, g])
            first, second, g, d = first[o], second[o], g[o], d[o]
            fresh = np.r_[True, (g[1:] != g[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
            new_doc = fresh.copy()
            new_doc[1:] |= d[1:] != d[:-1]
            start = np.flatnonzero(fresh)
            self.short.append((g[start], first[start], second[start], np.diff(np.r_[start, len(d)]), np.add.reduceat(new_doc.astype(np.int64), start)))
            self.held += len(start)
        self._add_long(data, begins, size, doc, group)

    def _add_long(self, data, begins, size, doc, group) -> None:
        width = 32
        at = np.flatnonzero(size > 16)
        while len(at):
            now = at[size[at] <= width] if width <= WIDEST else at
            if len(now) and width <= WIDEST:
                place = np.arange(width)
                cells = data[np.minimum(begins[now][:, None] + place, len(data) - 1)]
                cells[place >= size[now][:, None]] = 0
                terms = np.ascontiguousarray(cells).view(f"S{width}").ravel()
            elif len(now):
                terms = np.array([data[b:b + n].tobytes() for b, n in zip(begins[now].tolist(), size[now].tolist(), strict=True)], object)
            if len(now):
                o = np.argsort(terms, kind="stable")
                o = o[np.argsort(group[doc[now]][o], kind="stable")]
                terms, d = terms[o], doc[now][o]
                g = group[d]
                fresh = np.r_[True, (g[1:] != g[:-1]) | (terms[1:] != terms[:-1])]
                new_doc = fresh.copy()
                new_doc[1:] |= d[1:] != d[:-1]
                start = np.flatnonzero(fresh)
                n, df = np.diff(np.r_[start, len(d)]), np.add.reduceat(new_doc.astype(np.int64), start)
                self.long += zip(g[start].tolist(), terms[start].tolist(), n.tolist(), df.tolist(), strict=True)
                self.held += len(start)
            at = at[size[at] > width] if width <= WIDEST else at[:0]
            width *= 2

    def merge(self, one_document: bool = False) -> None:
        """One run a (group, term). Runs that are parts of one document count it once."""
        if self.short:
            g, first, second, n, df = (np.concatenate(x) for x in zip(*self.short, strict=True))
            o = radix_order([second, first, g])
            g, first, second, n, df = g[o], first[o], second[o], n[o], df[o]
            start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
            df = np.ones(len(start), np.int64) if one_document else np.add.reduceat(df, start)
            self.short = [(g[start], first[start], second[start], np.add.reduceat(n, start), df)]
        sums: dict[tuple[int, bytes], tuple[int, int]] = {}
        for group, term, n, df in self.long:
            m, e = sums.get((group, term), (0, 0))
            sums[group, term] = (m + n, 1 if one_document else e + df)
        self.long = [(*key, *value) for key, value in sums.items()]
        self.held = sum(len(x[0]) for x in self.short) + len(self.long)

    def take(self, other: Runs) -> None:
        self.short += other.short
        self.long += other.long
        self.held += other.held

    def batch(self, groups: list[tuple[str, str]]) -> pa.RecordBatch:
        g, first, second, n, df = (np.concatenate(x) for x in zip(*self.short, strict=True)) if self.short else [np.zeros(0, np.uint64)] * 5
        head = np.zeros((len(self.long), 2), ">u8")
        for i, x in enumerate(self.long):
            head[i] = np.frombuffer(x[1][:16], ">u8")
        whose = np.r_[g.astype(np.int64), np.array([x[0] for x in self.long], np.int64)]
        words = [np.r_[a, head[:, i].astype(np.uint64)] ^ _SIGN for i, a in enumerate((first, second))]
        text = pa.concat_arrays([pa.nulls(len(g), pa.string()), pa.array([x[1] for x in self.long], pa.binary()).cast(pa.string())])
        counts = [np.r_[a.astype(np.int64), np.array([x[k] for x in self.long], np.int64)] for k, a in ((2, n), (3, df))]
        names = [pa.array([x[i] for x in groups], pa.string()).take(pa.array(whose)) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*names, *[pa.array(w.view(np.int64)) for w in words], text, *map(pa.array, counts)],
                                          names=["lang", "source", "w0", "w1", "long_term", "n", "df"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, w0, w1, long_term, n, df): occurrences and documents, merged inside tasks.

    w0 and w1 are the first 16 bytes as words whose sign bit is flipped, so that
    they order as bytes; long_term is null for terms that they hold whole."""

    def run(batches):
        codes: dict[tuple[str, str], int] = {}
        held = Runs()
        for batch in batches:
            pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            group = np.array([codes.setdefault(x, len(codes)) for x in pairs], np.int64)
            part, part_doc = Runs(), -1
            for doc, data, offsets, whole in pieces(*_joined(batch.column("text"))):
                if part_doc not in (-1, doc):
                    part.merge(one_document=True)
                    held.take(part)
                    part, part_doc = Runs(), -1
                if whole:
                    held.add(data, offsets, group[doc:doc + len(offsets) - 1])
                else:
                    part.add(data, offsets, group[doc:doc + 1])
                    part.merge(one_document=True)
                    part_doc = doc
                if held.held > HELD:
                    held.merge()
                    if held.held > HELD // 2:
                        yield held.batch(list(codes))
                        held = Runs()
            if part_doc != -1:
                held.take(part)
        held.merge()
        if held.held:
            yield held.batch(list(codes))

    return docs.mapInArrow(run, "lang string, source string, w0 long, w1 long, long_term string, n long, df long")


def _share(count: str, total: str) -> str:
    """1 + floor(10**9 * (count + 1) / (total + v)), exactly."""
    return f"1 + (cast({count} + 1 AS decimal(20,0)) * 1000000000BD) div cast({total} + v AS decimal(20,0))"


def _tile_sums(entries: pa.Table, sources: pa.Table) -> pa.Table:
    """Of one bucket of terms and one tile: for each left and right source the sum of
    f over the terms that either has, and how many those are."""
    out = {"lang": [], "source": [], "item": [], "value": [], "covered": []}
    kinds = {"lang": pa.string(), "source": pa.string(), "item": pa.string(), "value": pa.int64(), "covered": pa.int64()}
    if entries.num_rows and sources.num_rows:
        sides = []
        for side in ("is_left", "is_right"):
            known = sources.filter(sources.column(side))
            mine = entries.filter(entries.column(side))
            code = pa.compute.index_in(mine.column("source"), value_set=known.column("source").combine_chunks()).to_numpy()
            sides.append((known.column("source").to_pylist(), known.column("p0").to_numpy(), code.astype(np.int64), mine))
        words = [np.concatenate([m.column(c).to_numpy() for *_, m in sides]) for c in ("w0", "w1")]
        text = pa.concat_arrays([c for *_, m in sides for c in m.column("long_term").chunks] or [pa.nulls(0, pa.string())])
        words.append(pa.compute.fill_null(text, "").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64))
        o = np.lexsort(words)
        fresh = np.zeros(len(o), bool)
        for w in words:
            fresh[1:] |= w[o][1:] != w[o][:-1]
        term = np.empty(len(o), np.int64)
        term[o] = np.cumsum(fresh)
        (left, left0, left_code, lm), (right, right0, right_code, rm) = sides
        left_term, right_term = term[:len(left_code)], term[len(left_code):]
        left_p, right_p = lm.column("p").to_numpy(), rm.column("p").to_numpy()
        o = np.lexsort((left_term, left_code))
        left_code, left_term, left_p = left_code[o], left_term[o], left_p[o]
        o = np.argsort(right_term, kind="stable")
        right_code, right_term, right_p = right_code[o], right_term[o], right_p[o]
        terms = int(term.max()) + 1
        value = np.zeros((len(left), len(right)), np.int64)
        covered = np.zeros((len(left), len(right)), np.int64)
        for base in range(0, terms, 4096):
            size = min(4096, terms - base)
            ra, rb = np.searchsorted(right_term, (base, base + size))
            dense = np.repeat(right0[None, :], size, axis=0)
            dense[right_term[ra:rb] - base, right_code[ra:rb]] = right_p[ra:rb]
            by = ra + np.argsort(right_code[ra:rb], kind="stable")
            edge = np.searchsorted(right_code[by], np.arange(len(right) + 1))
            for a in range(len(left)):
                la, lb = np.searchsorted(left_code, (a, a + 1))
                la, lb = la + np.searchsorted(left_term[la:lb], (base, base + size))
                has = left_term[la:lb] - base
                q = dense[has]
                value[a] += ((left_p[la:lb, None] - q) ** 2 // q).sum(axis=0)
                # terms that only the right source has
                absent = np.ones(size, bool)
                absent[has] = False
                alone = absent[right_term[by] - base]
                q = right_p[by]
                total = np.r_[0, np.cumsum(np.where(alone, (left0[a] - q) ** 2 // q, 0))]
                value[a] += total[edge[1:]] - total[edge[:-1]]
                total = np.r_[0, np.cumsum(alone)]
                covered[a] += len(has) + total[edge[1:]] - total[edge[:-1]]
        i, j = np.nonzero(np.array(left, object)[:, None] != np.array(right, object)[None, :])
        out = {"lang": [entries.column("lang")[0].as_py()] * len(i), "source": [left[x] for x in i], "item": [right[x] for x in j],
               "value": value[i, j], "covered": covered[i, j]}
    return pa.table({k: pa.array(out[k], t) for k, t in kinds.items()})


def _tiled(rows: DataFrame) -> DataFrame:
    """A row for each tile that its source is a left or right side of."""
    roles = F.expr("""flatten(transform(sequence(0, blocks - 1), y -> filter(array(
        named_struct('i', block, 'j', y, 'is_left', true, 'is_right', y = block),
        named_struct('i', y, 'j', block, 'is_left', false, 'is_right', true)), s -> s.is_left OR y <> block)))""")
    return rows.withColumn("block", F.expr("CAST(pmod(xxhash64(source), blocks) AS int)")).withColumn("role", F.explode(roles)).select("*", "role.*")


def _decoded(rows: DataFrame) -> DataFrame:
    """The words of short terms back as text."""

    def run(batches):
        for batch in batches:
            words = np.empty((batch.num_rows, 2), ">u8")
            for k in (0, 1):
                words[:, k] = batch.column(f"w{k}").to_numpy().view(np.uint64) ^ _SIGN
            words[batch.column("long_term").is_valid().to_numpy(zero_copy_only=False)] = 0  # their words can end inside a character
            short = pa.array(words.view("S16").ravel().tolist(), pa.binary()).cast(pa.string())
            item = pa.compute.coalesce(batch.column("long_term"), short)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("source"), item, batch.column("value"), batch.column("rank")],
                                             names=["lang", "source", "item", "value", "rank"])

    return rows.mapInArrow(run, "lang string, source string, item string, value long, rank int")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    key = ["lang", "w0", "w1", "long_term"]
    # one exchange by (lang, term) serves the counts of the groups and of the language
    counts = (term_counts(read).repartition(*key).groupBy("lang", "source", "w0", "w1", "long_term")
              .agg(F.sum("n").alias("n"), F.sum("df").alias("df")))
    of_term = Window.partitionBy(*key)
    kept = write_table(
        counts.withColumns({"all_n": F.sum("n").over(of_term), "docs": F.sum("df").over(of_term),
                            "head": (F.row_number().over(of_term.orderBy("source")) == 1).cast("long")})
        .filter(F.col("docs") >= min_docs).drop("df", "docs"), "audit-counts")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("head").alias("heads"), F.count("*").alias("entries"))
    groups = (read.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "heads", "entries")]))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.sum("heads").alias("v"),
                                       F.sum("entries").alias("entries"), F.count("*").alias("sources"))
    langs = langs.withColumn("v", F.when(F.col("v") <= 2 * 10**9, F.col("v")).otherwise(F.raise_error(F.lit("more than 2e9 kept terms: sums would not fit 64 bits")).cast("long")))
    info = write_table(
        groups.drop("heads", "entries").join(langs, "lang")
        .withColumns({"p0": F.expr(f"CASE WHEN v > 0 THEN {_share('0L', 'total')} END"),
                      "blocks": F.expr(f"CAST(ceil(sources / {TILE}) AS int)"),
                      # a bucket returns a sum for each pair of its tile, so it holds about as many entries at least
                      "buckets": F.expr(f"CAST(greatest(1, ceil(entries * least(sources, {TILE}) / sources / greatest({ENTRIES}, pow(least(sources, {TILE}), 2)))) AS int)")}),
        "audit-groups")
    seen = (kept.join(info, ["lang", "source"])
            .withColumns({"p": F.expr(_share("n", "total")), "q": F.expr(_share("all_n", "all_total"))}))
    # part term
    above = seen.filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "w0", "w1", F.asc_nulls_first("long_term"))
    terms = above.select("lang", "source", "w0", "w1", "long_term", "value", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= top)
    # part pair
    tile = ["lang", "i", "j", "bucket"]
    entries = (_tiled(seen.filter("sources > 1").select("lang", "source", "w0", "w1", "long_term", "p", "blocks", "buckets"))
               .select(*tile[:3], F.expr("CAST(pmod(xxhash64(w0, w1, long_term), buckets) AS int)").alias("bucket"),
                       "source", "w0", "w1", "long_term", "p", "is_left", "is_right"))
    sides = (_tiled(info.filter("sources > 1 AND v > 0").select("lang", "source", "p0", "blocks", "buckets"))
             .select(*tile[:3], F.explode(F.expr("sequence(0, buckets - 1)")).alias("bucket"), "source", "p0", "is_left", "is_right"))
    sums = (entries.groupBy(*tile).cogroup(sides.groupBy(*tile))
            .applyInArrow(_tile_sums, "lang string, source string, item string, value long, covered long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("covered").alias("covered")))
    a = info.select("lang", "source", "v", "p0")
    b = info.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = (a.join(b, "lang").filter("source <> item").join(sums, ["lang", "source", "item"], "left")
             .select("lang", "source", "item", F.expr("CASE WHEN v > 0 THEN coalesce(value, 0L) + (v - coalesce(covered, 0L)) * ((p0 - q0) * (p0 - q0) div q0) ELSE 0L END").alias("value")))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    shape = ["lang", "source", "part", "item", "value", "rank"]
    return (_decoded(terms).withColumn("part", F.lit("term")).select(*shape)
            .unionByName(pairs.withColumn("part", F.lit("pair")).select(*shape)))
