"""The training-data operators against brute force, oracles and edge cases."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from ledgerlens.llm import decontaminate as dec
from ledgerlens.llm import host_trust, jaccard_join, language_id, license_scan, line_dedup, packing, prefix_free, topk, toxicity
from ledgerlens.llm.common import alnum_words, space_words
from ledgerlens.llm.queries import ORACLES, QUERIES
from ledgerlens.sources.tables import TABLES
from scripts.oracle_check import digest

from ..conftest import SF_CHECK, SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key int"


def corpus(seed: int = 3) -> list[tuple]:
    """Texts that share words, lines and passages; nulls, empties, ties, repeated rows, a long text."""
    rng = random.Random(seed)
    words = [f"w{i}" if i % 3 else f"Wö{i}" for i in range(60)]
    para = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(25)]
    texts = ["\n".join(rng.choices(para, k=rng.randint(1, 6))) for _ in range(40)]
    texts += [texts[0], texts[1] + " tail", None, "", " \n ", "one", "one", "one two", "ONE TWO", "x" * 300, "x" * 310,
              " ".join(rng.choices(words, k=4000))]
    base = [f"v{i}" for i in range(60)]
    texts += [" ".join(base[:i] + ["q"] + base[i + 1:]) for i in range(0, 60, 7)] + [" ".join(base)]
    texts += [" ".join(f"s{i}" for i in range(a, b)) for a, b in ((0, 11), (0, 12), (1, 12), (0, 21), (0, 22), (1, 22), (0, 23))]
    rows = [(i * 3 % 101, t, None if i % 7 == 0 else "en", f"s{i % 3}", len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[2], None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# -- oracles ------------------------------------------------------------------

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(columns)
    assert digest(sdf.columns, [tuple(r) for r in sdf.collect()]) == digest(columns, [tuple(r) for r in cur.fetchall()])


# -- 1 line dedup -------------------------------------------------------------

@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup(docs, rows, least):
    key = lambda r: (r[0] is None, r[0] or 0)
    seen = {}
    for r in sorted(rows, key=key):
        ls = r[1].split("\n") if r[1] is not None else []
        for i in range(len(ls) - least + 1):
            seen[tuple(ls[i:i + least])] = min(seen.get(tuple(ls[i:i + least]), (key(r), i)), (key(r), i))
    want = Counter()
    for r in rows:
        ls = r[1].split("\n") if r[1] is not None else []
        gone = {i + j for i in range(len(ls) - least + 1) if seen[tuple(ls[i:i + least])] < (key(r), i) for j in range(least)}
        kept = None if r[1] is None else "\n".join(x for i, x in enumerate(ls) if i not in gone)
        want[r[0], kept, len(ls), len(gone), r[5]] += 1
    assert got(line_dedup.dedup(docs, min_lines=least), "doc_id", "text", "n_lines", "n_removed", "score") == want


def test_long_lines_go_alone(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    texts = {1: f"a\n{passage}\nb", 2: passage, 3: f"c\n{passage}\nd\n{passage}", 4: f"e\n{passage} more\nf", 5: "e\nshort", 6: "g\nshort"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = {(i, t, 0, 0) for i, t in texts.items()} - {(i, texts[i], 0, 0) for i in (2, 3)} | {(2, "", 1, 1), (3, "c\nd", 2, 2)}
    assert set(got(line_dedup.dedup(docs, long_words=50), "doc_id", "text", "n_removed", "n_runs")) == want
    assert set(got(line_dedup.dedup(docs), "doc_id", "text", "n_removed", "n_runs")) == {(i, t, 0, 0) for i, t in texts.items()}


def test_suffix_order(spark):
    seqs = {1: "a b a b c", 2: "b a b", 3: "a b a b c d", 4: "a"}
    d = spark.createDataFrame([(k, v.replace(" ", "\n")) for k, v in seqs.items()], "doc_id long, text string")
    lines = line_dedup.lines(d).cache()
    ids = {(r["d"], r["pos"]): (r["a"], r["b"]) for r in lines.collect()}
    ranks = {(r["d"], r["pos"]): r["rank"] for r in line_dedup.suffix_ranks(lines).collect()}
    suffix = lambda p: [ids[p[0], q] for q in range(p[1], len(seqs[p[0]].split()))]
    for x in ranks:
        assert ranks[x] == sum(suffix(y) < suffix(x) for y in ranks)


# -- 2 host trust -------------------------------------------------------------

def test_host_trust(spark):
    link = '<a href="https://{}/x">x</a>'
    pages = [(1, "http://A.net/en", None), (2, "https://x.example.net/en/a?b", link.format("good.org")), (3, "http://example.com/de/1", ""),
             (4, "http://sub.example.com/de/#f", None), (5, "http://o.org/fr/", None), (6, "http://good.org/a", None), (7, None, None),
             (8, "no-scheme", None), (9, "http://spam.io/a", link.format("a.net")), (10, "http://x.net", link.format("a.net")),
             (11, "ftp://badexample.com/de/", None), (11, "ftp://badexample.com/de/", None)]
    out = host_trust.judge(spark.createDataFrame(pages, "page_id long, url string, html string"))
    have = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert out.count() == 12
    assert have[1] == ("a.net", "/en", "net/", "block") and have[2] == ("x.example.net", "/en/a", "example.net/en/", "allow")
    assert have[3][2:] == have[4][2:] == ("example.com/de/", "block") and have[5][2:] == ("org/fr/", "allow")
    assert have[6] == ("good.org", "/a", None, "allow") and have[7] == have[8] == ("", "", None, "allow")
    assert have[9] == ("spam.io", "/a", None, "block")  # links to a blocked host
    assert have[10] == ("x.net", "", None, "block") and have[11][2:] == (None, "allow")


# -- 3 decontamination --------------------------------------------------------

@pytest.mark.parametrize("block", [100_000, 7])
def test_decontaminate(spark, docs, rows, block):
    items = [(1, rows[3][1]), (10, " ".join(rows[51][1].split()[100:130])), (2, "One"), (3, None), (4, " ,"), (None, "one two"), (2, "One")]
    out = dec.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    want = Counter()
    for r in rows:
        words = alnum_words(r[1].encode() if r[1] else None)
        hit, names = set(), set()
        for item, text in items:
            w = alnum_words(text.encode() if text else None)
            k = min(10, len(w))
            windows = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
            for i in range(len(words) - k + 1):
                if tuple(words[i:i + k]) in windows:
                    hit.update(range(i, i + k))
                    names.update([str(item)] if item is not None else [])
        want[r[0], len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), r[5]] += 1
    assert sum(k[5] for k in want)
    assert got(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "score") == want


# -- 4 Jaccard join -----------------------------------------------------------

def shingles(text):
    w = space_words(text.encode() if text else None)
    k = min(3, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


@pytest.mark.parametrize("short", [8, 2])
def test_jaccard_join(docs, rows, short, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))
    assert got(jaccard_join.join(docs), "doc_id", "n_shingles", "component_id") == want


def components_of(texts, size, percent):
    """The smallest row number of each row's component, by all pairs; None: no shingles."""
    sets = []
    for t in texts:
        w = space_words(t.encode() if t else None)
        k = min(size, len(w))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return [r if sets[i] else None for i, r in enumerate(root)]


def varied(seed: int = 5) -> list[str]:
    """Groups of texts of 5 to 120 words, the members a few words apart: similarities on both sides of 0.8."""
    rng = random.Random(seed)
    texts = []
    for g in range(60):
        base = [f"g{g}x{i}" for i in range(rng.randint(5, 120))]
        for _ in range(5):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(own))
                own[at:at + 1] = rng.choice(([], [f"n{rng.randrange(10**6)}"], [own[at], f"n{rng.randrange(10**6)}"]))
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("size,percent", [(5, 80), (3, 90), (2, 60)])
def test_jaccard_join_of_other_sizes(spark, size, percent):
    texts = varied()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {(i, r) for i, r in enumerate(components_of(texts, size, percent))}
    assert set(got(jaccard_join.join(docs, percent=percent, size=size), "doc_id", "component_id")) == want


def test_pipeline_drops_near_copies(spark):
    base = [f"b{i}" for i in range(150)]
    copy = " ".join(x if i not in (40, 80, 120) else "other" for i, x in enumerate(base))  # 2 % of the words
    rows = [(1, " ".join(base), "en", "s", 1), (2, copy, "en", "s", 1), (3, "something else", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert components_of([r[1] for r in rows], 3, 90)[1] == 1  # the values of op4 keep it
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_alike(spark, docs, SF_SMALL).collect()) == [1, 3]


# -- 5 top-k ------------------------------------------------------------------

def test_topk(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8 if i % 9 else 5)]) for i in range(400)]
    vectors += [(i, vectors[50][1]) for i in range(400, 430)] + [(430, None), (431, [1.0, None]), (432, [float("inf")]), (433, []), (None, [1.0]), vectors[100]]
    out = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("id") % 50 == 0, k=5, block_rows=97, query_block=4)
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for q in {i for i, _ in ints if i % 50 == 0}:
        ranked = sorted((-sum(a * b for a, b in zip(own, v)), i) for o, own in ints if o == q for i, v in ints if i != q)
        want += Counter((q, n + 1, i, -s) for n, (s, i) in enumerate(ranked[:5]))
    assert got(out, "query_id", "rank", "vec_id", "score") == want


def test_topk_of_rows_that_share_an_id(spark):
    rows = [(50, [1.0]), (50, [3.0]), (1, [1.0]), (1, [2.0]), (2, [1.5])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, k=3)
    assert got(out, "query_id", "rank", "vec_id", "score") == Counter([(50, 1, 1, 6 * 256**2), (50, 2, 2, 4.5 * 256**2), (50, 3, 1, 3 * 256**2)])
    with pytest.raises(Exception, match="leave 64 bits"):
        topk.top_k(spark.createDataFrame([(50, [3e9]), (1, [3e9])], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()


def test_decontaminate_with_null_items_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "x", [1])], "doc_id long, text string, _spans int, _N string, _items array<int>")
    bench = spark.createDataFrame([(None, "B")], "item_id long, text string")
    row = dec.decontaminate(docs, bench).first()
    assert (row["n_words"], row["n_hit"], row["n_items"], row["contaminated"]) == (3, 1, 0, True)
    assert (row["_spans"], row["_N"], row["_items"]) == (7, "x", [1])


# -- 6 language ID ------------------------------------------------------------

def test_ppm_code_lengths():
    fit = {"a": b"abracadabra abra", "b": b"bananas and bandanas"}
    rows = {}
    for size in range(1, 5):
        grams = [(i, int.from_bytes(t[j:j + size], "big")) for i, t in enumerate(fit.values()) for j in range(len(t) - size + 1)]
        count = Counter(grams)
        rows[size] = tuple(np.array(x, np.int64) for x in zip(*((i, g, n) for (i, g), n in count.items())))
    trees = language_id.Trees(["a", "b"], rows, 3)

    def cost(text, at, seen, order):
        ctx = text[max(0, at - order):at]
        bits = 0.0
        while True:
            nxt = Counter(seen[j + len(ctx)] for j in range(len(seen) - len(ctx)) if seen[j:j + len(ctx)] == ctx)
            n, q = sum(nxt.values()), len(nxt)
            if nxt[text[at]]:
                return bits - math.log2(nxt[text[at]] / (n + q))
            bits += -math.log2(q / (n + q)) if n else 0
            if not ctx:
                return bits + 8
            ctx = ctx[1:]

    texts = [b"abra", b"", b"xyz banana", b"d", b"and abracadabra!"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bits = trees.lengths(data, np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        for j, seen in enumerate(fit.values()):
            assert bits[i, j] == pytest.approx(sum(cost(t, at, seen, 3) for at in range(len(t))))


def test_language_accuracy(spark):
    out = QUERIES["op6_language_id"](spark, SF_CHECK).join(spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.97


def test_language_edges(spark, docs, empty):
    model = language_id.train(docs)
    have = {(r["text"], r["lang_pred"]) for r in language_id.identify(docs, model).collect()}
    assert {(None, "und"), ("", "und"), (" \n ", "und"), ("one", "en")} <= have
    assert language_id.train(empty) is None
    assert set(got(language_id.identify(docs, None), "lang_pred", "score")) == {("und", 0.0)}


# -- 7 licenses ---------------------------------------------------------------

def test_licenses(spark):
    text = dict(license_scan.TEMPLATES)
    filler = " ".join(f"f{i}" for i in range(200))
    bsd = text["BSD-3-Clause"]
    texts = [(1, f"{filler}\n{text['MIT']}\n{filler} {text['Apache-2.0'].upper()} {text['MIT']}"), (2, filler), (3, None), (4, ""),
             (5, f"{filler} {bsd.replace('conditions are', 'rules are')}"), (6, f"{filler} {bsd.replace('binary', 'x').replace('provided', 'y')}"),
             (7, "license MIT the under Released"), (1, f"{filler}")]
    out = got(license_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "n_licenses", "licenses")
    assert out == Counter([(1, 2, "Apache-2.0,MIT"), (2, 0, ""), (3, 0, ""), (4, 0, ""), (5, 1, "BSD-3-Clause"), (6, 0, ""), (7, 0, ""), (1, 0, "")])


@pytest.mark.parametrize("notice,name", [
    ('Licensed under the Apache License, Version 2.0 (the "License");', "Apache-2.0"), ("Released under the MIT License, see below", "MIT"),
    ("Released under the MIT License\nand more", "MIT"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("...Licensed under CC BY-NC 4.0...", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3, or later", "GPL-3.0"), ("Licensed under CC BY-NC 4.0.1", ""),
    ("Licensed under the Apache License, Version 20", "")])
def test_license_without_the_final_stop(spark, notice, name):
    docs = spark.createDataFrame([(1, f"some words {notice} some words"), (2, notice)], "doc_id long, text string")
    assert set(got(license_scan.scan(docs), "doc_id", "licenses")) == {(1, name), (2, name)}


# -- 8 packing ----------------------------------------------------------------

def test_packing(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(packing.pieces(docs, path, size=64), size=64, group_rows=20).collect()
    whole = Tokenizer.from_file(path)
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2])
    bins, total = defaultdict(list), 0
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
        crcs = {zlib.crc32(np.array(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) for x in ids[r["doc_id"]]}
        assert r["ids_crc32"] in crcs and (r["piece"] == 0 or r["length"] == 64)
    assert total == sum(len(x) for v in ids.values() for x in v)
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * total / 64 + 2


def test_tokens_equal_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens, whole = packing.Tokens(path), Tokenizer.from_file(path)
    for t in ["don't we'll", "a’b  x\x1f y² ½", "<|endoftext|> hi", " \n\n x\t\t", "日本 テ 12ª", "ab\x85c d", "a_b __ 1_2", "Größe naïve  ", "\x00\x7f"]:
        assert np.frombuffer(tokens.encode(t), "<u4")[:-1].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 4, 4, 5, 5, 3, 3, 2, 2])
    bins = packing.local_search(lengths, [[0, 6], [1, 7], [2, 4], [3, 5], [8], [9]], 10)
    assert sorted(x for b in bins for x in b) == list(range(10)) and all(lengths[b].sum() <= 10 for b in bins)
    assert len(bins) == 5  # a local optimum; six bins before


# -- 9 toxicity ---------------------------------------------------------------

def test_nearest_is_exact():
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"t{i}" for i in range(30)], k=12)).encode() for _ in range(400)]
    index = toxicity.Index([(i, i % 2, t) for i, t in enumerate(texts)], [f"t{i}".encode() for i in range(25)],
                           {f"t{i}".encode(): i + 1 for i in range(25)} | {b"": 400}, k=7)
    dense = index.weights.reshape(25, -1)[:, :400]
    for t in [*texts[:40], b"t1", b"t1 t2 t2 nothing"]:
        where, values = index.vector(t)
        full = (values @ dense[where]).round(9)
        want = sorted((-c, i) for i, c in enumerate(full) if c > 0)[:7]
        at, cosines = index.nearest(t)
        assert cosines.tolist() == pytest.approx([-c for c, _ in want], abs=1e-8)
    assert index.vote(None)[0] is None and index.vote(b"zzz")[0] is None


def test_toxicity_accuracy(spark):
    out = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    held = out.filter("held_out")
    assert held.filter("toxic = 1").select(F.avg("predicted")).first()[0] > 0.75
    assert held.filter("toxic = 0").select(F.avg("predicted")).first()[0] < 0.05


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([(None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert set(got(toxicity.score(docs, toxicity.train(docs, none)), "score", "predicted")) == {(0.0, 0)}


# -- 10 byte strings ----------------------------------------------------------

@pytest.mark.parametrize("size,trigger", [(50, 24), (20, 9)])
def test_prefix_free(docs, rows, size, trigger):
    key = lambda r: 2**63 - 1 if r[0] is None else r[0]
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - size + 1):
            first[b[i:i + size]] = min(first.get(b[i:i + size], key(r)), key(r))
    want = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if first[b[i:i + size]] < key(r):
                gone[i:i + size] = b"\x01" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[r[0], len(b), sum(gone), sum(g and not p for g, p in zip(gone, b"\x00" + gone)), hashlib.sha256(kept).hexdigest(), kept] += 1
    out = prefix_free.dedup(docs, length=size, trigger=trigger)
    have = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in out.collect())
    assert have == want


def test_prefix_free_buckets_are_even(spark):
    # random words give many triggers; one passage that all documents hold must not fill a bucket either
    rng = random.Random(8)
    passage = " ".join(f"passage{i}" for i in range(40))
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(400)) + passage for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, text string").coalesce(1)
    sent = Counter()
    for r in prefix_free._trigger_parts(docs, 64, 50, 24).filter("NOT settled").collect():
        sent[r["bucket"]] += len(r["high"])
    assert len(sent) == 64 and max(sent.values()) < 2 * sum(sent.values()) / 64
    out = {r["doc_id"]: r["n_removed"] for r in prefix_free.dedup(docs.withColumnRenamed("d", "doc_id")).collect()}
    # bytes beside the passage can be alike by chance
    assert out.pop(0) == 0 and all(0 <= n - len(passage) <= 6 for n in out.values()) and len(out) == 299


def test_prefix_free_spans_in_little_memory():
    # one trigger in the middle of texts that differ around it: all phrases are in one part
    rng, n = np.random.default_rng(8), 20_000
    body = rng.integers(97, 123, (n, 76)).astype(np.uint8)
    body[:, 26:50] = np.frombuffer(b"the trigger of everybody", np.uint8)
    body[n // 2:, :50] = body[:n // 2, :50]  # the first window of the second half is found in the first
    d, start = np.arange(n), np.zeros(n, np.int64)
    tracemalloc.start()
    who, first, last = prefix_free._spans_of(d, start, np.full(n, 26), np.full(n, 26), body.ravel(), 76 * d, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert who.tolist() == list(range(n // 2, n)) and set(first.tolist()) == {0} and min(last.tolist()) == 50
    assert peak < 500 * n


# -- empty tables and the pipeline ---------------------------------------------

def test_empty_tables(spark, empty):
    import public_tokenizers

    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_dedup.dedup(empty).count() == 0
    assert host_trust.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert dec.decontaminate(empty, bench).count() == 0
    assert jaccard_join.join(empty).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).count() == 0
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    assert license_scan.scan(empty).count() == 0
    assert packing.pack(packing.pieces(empty, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert prefix_free.dedup(empty).count() == 0


def test_pipeline_stages(spark, docs, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "packing"]
    table = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF_SMALL).cache()
        assert table.columns == corpus_pipeline.COLUMNS and table.count() > 0
    groups = jaccard_join.join(table).filter("n_shingles > 0").groupBy("component_id").count()
    assert groups.filter("count > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, table, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == table.select("doc_id").distinct().count()


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.count() > 0 and isinstance(out.schema["sequence_id"].dataType, T.LongType)


def plain_lines(rows):
    """Rows of the line dedup stage: later copies of two lines and of long lines cut out, emptied texts gone."""
    place = lambda r, i: (r[0] is None, r[0] or 0, i)
    first = {}
    for r in rows:
        own = r[1].split("\n") if r[1] is not None else []
        for i in range(len(own) - 1):
            first[own[i], own[i + 1]] = min(first.get((own[i], own[i + 1]), place(r, i)), place(r, i))
        for i, x in enumerate(own):
            first[x] = min(first.get(x, place(r, i)), place(r, i))
    out = []
    for r in rows:
        own = r[1].split("\n") if r[1] is not None else []
        gone = {i + j for i in range(len(own) - 1) if first[own[i], own[i + 1]] < place(r, i) for j in (0, 1)}
        gone |= {i for i, x in enumerate(own) if len(space_words(x.encode())) >= 50 and first[x] < place(r, i)}
        text = "\n".join(x for i, x in enumerate(own) if i not in gone)
        if not gone:
            out.append(r)
        elif text:
            out.append((r[0], text, r[2], r[3], len(text)))
    return Counter(out)


def plain_alike(rows, keys):
    """Rows of the Jaccard stage: of each component the row of least id, then key; rows without words."""
    names = components_of([r[1] for r in rows], corpus_pipeline.ALIKE_WORDS, corpus_pipeline.ALIKE_PERCENT)
    best, out = {}, Counter()
    for r, name in zip(rows, names, strict=True):
        if name is None:
            out[r] += 1
        else:
            best[name] = min(best.get(name, r), r, key=lambda x: (x[0] is None, x[0] or 0, keys[x]))
    return out + Counter(best.values())


def plain_clean(rows, items):
    """Rows of the decontamination stage: those without a window of an item."""
    windows = set()
    for item, text in items:
        w = alnum_words(text.encode() if text else None)
        k = min(10, len(w))
        windows |= {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w and item is not None else set()
    sizes = {len(x) for x in windows}
    out = Counter()
    for r in rows:
        w = alnum_words(r[1].encode() if r[1] else None)
        out[r] += not any(tuple(w[i:i + k]) in windows for k in sizes for i in range(len(w) - k + 1))
    return +out


def test_pipeline_stages_keep_the_rows_of_their_rule(spark, rows):
    own = [r[:5] for r in rows]
    quote = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").filter("text IS NOT NULL").first()["text"]
    alike = [f"a{i}" for i in range(90)]
    near = " ".join([*alike[:40], "z", *alike[41:]])
    own += [(None, "null id, text of its own", "en", "s1", 1), (None, "quite another text without an id", "en", "s1", 1), (None, " ".join(alike), "en", "s1", 1),
            (None, None, None, None, None), (None, None, None, None, None), (None, "null id, text of its own", "en", "s1", 1),
            (500, " ".join(alike), "en", "s1", 1), (501, near, "en", "s1", 1), (501, "a text unlike the other one of its id", "en", "s2", 1),
            (502, near, "de", "s1", 1), (502, near, "en", "s1", 1), (503, "x\ny", "en", "s1", 1), (504, "x\ny", "en", "s1", 1), (505, quote, "en", "s1", 1)]
    passage = " ".join(f"p{i}" for i in range(50))
    own += [(510, f"before\n{passage}\nbehind", "en", "s1", 1), (511, passage, "en", "s1", 1), (512, f"other\n{passage}\nwords", "en", "s1", 1),
            (513, f"{passage[:-4]}\nshort", "en", "s1", 1), (514, f"not\n{passage[:-4]}\nlong", "en", "s1", 1)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in own], DOCS).repartition(3)
    plain = table.select(*corpus_pipeline.COLUMNS)
    stage = dict(corpus_pipeline.STAGES)

    kept = [tuple(r) for r in language_id.identify(plain, language_id.train(table)).collect()]
    want = Counter(r[:5] for r in kept if r[5] != "und" and r[6] >= 0.5)
    assert got(stage["language_id"](spark, table, SF_SMALL), *corpus_pipeline.COLUMNS) == want and len(kept) == len(own)

    assert got(stage["line_dedup"](spark, table, SF_SMALL), *corpus_pipeline.COLUMNS) == plain_lines(own)

    keys = {tuple(r)[:5]: tuple(r)[5:] for r in plain.select("*", *corpus_pipeline.row_key()).collect()}
    assert got(stage["jaccard_join"](spark, table, SF_SMALL), *corpus_pipeline.COLUMNS) == plain_alike(own, keys)

    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    clean = got(stage["decontaminate"](spark, table, SF_SMALL), *corpus_pipeline.COLUMNS)
    assert clean == plain_clean(own, items) and sum(clean.values()) < len(own)

    import public_tokenizers

    tokens = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter()
    for r in own:
        lengths[r[0]] += len(tokens.encode(r[1] or "")) // 4
    packed = Counter()
    for r in stage["packing"](spark, table, SF_SMALL).collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == lengths
