"""Operator 7, license scans: MinHash bands over overlapping text windows.

Words are ``[A-Za-z0-9.]+`` runs, lower-cased, without the full stops at their
ends ("2.0." is "2.0"), so a notice is found with and without its sentence's
stop, before a comma or at a line's end. (The SQL twin keeps those stops and
finds less: every notice it finds is found here.) Shingles are five words (a
template of fewer words is one shingle of all of them). A template of m
shingles belongs to the window class of its size; a document is covered by
windows of ``size`` shingles, each starting ``step`` after the one before
(``step`` at most a quarter of the size, 1 for small sizes), so some window
holds a template's copy but for a quarter of its length at worst.

Each of ``BANDS`` bands has one row: the least shingle under the band's hash. A
window and a template of Jaccard similarity J share a band with probability
``1 - (1 - J) ** BANDS``: a copy cut by a quarter and changed to containment
0.8 has J >= 0.4 and is retrieved with 1 - 4e-5, a whole copy in its window
always. Retrieved templates are verified: at least 80 % of the template's
shingles, as text, occur in the window widened by its step.

The least shingle of a band is a shingle, so a window can only share a band
with a template when it holds one of the templates' band shingles; documents
without any of these hashes cannot retrieve anything and skip the windows.
That is the whole corpus but for the documents that quote a license.

Only DataFrame functions are used, in one narrow pass: no shuffle, no skew, any
length of text. The templates are a fixed list of the module.

Edge cases: null, empty and wordless texts have no licenses; repeated rows are
scanned each; a license quoted twice counts once; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: License notices to find, by SPDX id.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]
SHINGLE = 5
BANDS = 20
CONTAINMENT = 80
WORD = r"[A-Za-z0-9](?:[A-Za-z0-9.]*[A-Za-z0-9])?"
#: Words with the stops at their ends, as the SQL twin has them.
STOPPED = r"[A-Za-z0-9.]+"


def template_words(text: str, word: str = WORD) -> list[str]:
    return [w.lower() for w in re.findall(word, text)]


def template_shingles(text: str, size: int = SHINGLE, word: str = WORD) -> list[str]:
    words = template_words(text, word)
    k = min(size, len(words))
    return list(dict.fromkeys(" ".join(words[i:i + k]) for i in range(len(words) - k + 1)))


def _chain(words: Column, n: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words: xxhash64 folded over the words."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    out = h
    for k in range(1, size):
        # arrays of different lengths: the shorter one's nulls are the runs that do not fit
        out = F.zip_with(F.slice(out, F.lit(1), F.greatest(n - k, F.lit(0))), F.slice(h, F.lit(k + 1), F.greatest(n - k, F.lit(0))),
                         lambda a, b: F.xxhash64(a, b))
    return out


def _band(b: int):
    return lambda shingle: F.xxhash64(shingle, F.lit(b))


def _window_test(words: Column, hashes: Column, k: int, size: int, step: int, band_keys: list[int], shingles: list[str], containment: int):
    """A predicate on a window's start: some band agrees and the shingles' texts are there."""
    texts, need = F.array(*[F.lit(s) for s in shingles]), -(-containment * len(shingles) // 100)

    def test(x: Column) -> Column:
        window = F.slice(hashes, x + 1, F.lit(size))
        retrieved = F.lit(False)
        for b, key in enumerate(band_keys):
            retrieved = retrieved | (F.array_min(F.transform(window, _band(b))) == F.lit(key))
        wide = F.slice(words, F.greatest(x + 1 - step, F.lit(1)), F.lit(size + 2 * step + k - 1))
        starts = F.sequence(F.lit(1), F.greatest(F.size(wide) - k + 1, F.lit(1)))
        there = F.transform(starts, lambda j: F.array_join(F.slice(wide, j, F.lit(k)), " "))
        return retrieved & (F.size(F.array_intersect(there, texts)) >= need)

    return test


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, bands: int = BANDS,
         containment: int = CONTAINMENT) -> DataFrame:
    """(doc_id, n_licenses, licenses): ids of the templates found, sorted."""
    spark = docs.sparkSession
    shapes: dict[tuple[int, int], list[tuple[str, list[str]]]] = {}
    for name, text in templates:
        shingles = template_shingles(text)
        shapes.setdefault((min(SHINGLE, len(template_words(text))), len(shingles)), []).append((name, shingles))
    words = F.filter(F.regexp_extract_all(F.lower(text_col), F.lit(WORD.replace("A-Z", "")), F.lit(0)), lambda w: w != "")
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(words, F.array().cast("array<string>")).alias("w")).withColumn("n", F.size("w"))
    widths = sorted({k for k, _ in shapes})
    for k in widths:
        out = out.withColumn(f"h{k}", _chain(F.col("w"), F.col("n"), k))
    found = []
    for (k, m), group in sorted(shapes.items()):
        size, step = m, max(1, m // 4)
        # band keys of the templates, by the same expressions as the windows'
        rows = [(i, name, s) for i, (name, shingles) in enumerate(group) for s in shingles]
        t = spark.createDataFrame(rows, "i int, name string, s string").withColumn("h", F.element_at(_chain(F.split("s", " "), F.lit(k), k), 1))
        keys = {}
        for r in t.select("i", "name", *[F.xxhash64("h", F.lit(b)).alias(f"b{b}") for b in range(bands)], "h").collect():
            for b in range(bands):
                value, shingle = keys.get((r["i"], b), (None, None))
                if value is None or r[f"b{b}"] < value:
                    keys[r["i"], b] = (r[f"b{b}"], r["h"])
        band_shingles = F.array(*[F.lit(h) for h in sorted({h for _, h in keys.values()})])
        h = F.col(f"h{k}")
        last = F.greatest(F.ceil((F.size(h) - size) / F.lit(step)).cast("int"), F.lit(0))
        windows = F.transform(F.sequence(F.lit(0), last), lambda x: x * step)
        possible = F.arrays_overlap(h, band_shingles)
        for i, (name, shingles) in enumerate(group):
            own = [keys[i, b][0] for b in range(bands)]
            hit = _window_test(F.col("w"), h, k, size, step, own, shingles, containment)
            found.append(F.when(possible & F.exists(windows, hit), F.lit(name)))
    names = F.array_sort(F.array_compact(F.array(*found)))
    return out.select("doc_id", names.alias("licenses")).select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))
