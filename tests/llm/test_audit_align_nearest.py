"""Operators 11 to 13 against SQL, whole-text encodings and exact search."""

import glob
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import nn_descent, source_audit, token_align
from ledgerlens.llm.queries import PIECES, SQL_SOURCES, TOKENIZER
from ledgerlens.session import ensure_checkpoint_dir
from ledgerlens.sources.tables import read_table

from ..conftest import SF_CHECK

DOCS = "doc_id long, text string, lang string, source string, p long, n string, block int"


def rows_of(texts, seed=1):
    rng = random.Random(seed)
    return [(i % 40 if i % 9 else None, t, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "ß"]), 7, "x", 1)
            for i, t in enumerate(texts)]


# -- 11 source divergence audit -----------------------------------------------

def mixed_texts(seed=2):
    rng = random.Random(seed)
    words = ["a", "Bee", "longer", "exactly8", "ninechars", "sixteencharacter", "sixteencharacterx", "sixteencharacterä", "ärger", "日本語のとても長い文字列です",
             "z" * 31, "z" * 32, "z" * 33, "y" * 1024, "y" * 1025, "y" * 3000, "ZED"]
    out = [" ".join(rng.choices(words, weights=range(20, 20 - len(words), -1), k=rng.randint(0, 25))) for _ in range(60)]
    return out + [None, "", "12 34 ...", "a1b2c3", out[0], out[0]]


def audited(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return Counter(tuple(r) for r in source_audit.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def by_sql(rows):
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in DOCS.split(", ")])  # noqa: F841
    return Counter(con.execute(SQL_SOURCES).fetchall())


def test_audit_equals_sql(spark):
    rows = rows_of(mixed_texts())
    got = audited(spark, rows)
    assert got == by_sql(rows) and {r[2] for r in got} == {"pair", "term"}


def test_audit_without_kept_terms(spark):
    rows = [(1, "one", "en", "a", 0, "", 0), (2, None, "en", "b", 0, "", 0), (3, "two", "de", "a", 0, "", 0)]
    assert audited(spark, rows) == Counter([("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)])
    assert audited(spark, []) == Counter()


def test_audit_tiles_of_sources(spark):
    """More sources than a tile holds, many of them without a term of the others."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{chr(97 + rng.randint(0, 9))}" for _ in range(rng.randint(0, 4))), "en", f"s{i % 230}", 0, "", 0) for i in range(700)]
    assert audited(spark, rows) == by_sql(rows)


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 50)
    texts = [b"short one", b"", b"word " * 100 + b"x" * 200 + b" word", b"tail"]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    found = Counter()
    for doc, data, cuts, whole in source_audit.pieces(np.frombuffer(b"".join(texts), np.uint8), offsets):
        for i in range(len(cuts) - 1):
            for w in data[cuts[i]:cuts[i + 1]].tobytes().replace(b"\0", b" ").split():
                found[doc + i, w] += 1
        assert whole or len(cuts) == 2
    assert found == Counter((i, w) for i, t in enumerate(texts) for w in t.split())


@pytest.mark.parametrize("parts", [1, 4])
def test_counts_of_a_text_in_parts(spark, parts):
    """A text far longer than a piece counts as one document."""
    long_text = "alpha beta gamma " * (parts * source_audit.PIECE // 17)
    df = spark.createDataFrame([(1, long_text, "en", "a"), (2, "alpha", "en", "a")], "doc_id long, text string, lang string, source string")
    counts = source_audit.term_counts(df.coalesce(1)).groupBy("lang").agg(F.sum("n").alias("n"), F.max("df").alias("df")).first()
    assert counts["n"] == len(long_text.split()) + 1 and counts["df"] == 2


def test_radix_order():
    rng = np.random.default_rng(0)
    low, high = rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(0, 3, 500, dtype=np.uint64)
    assert (source_audit.radix_order([low, high]) == np.lexsort((low, high))).all()


# -- 12 cross-tokenizer alignment ---------------------------------------------

NASTY = [None, "", "a▁b", " ", "  \n \n  x  ", "<s>a</s> <|endoftext|> b <0x41>", "ａ① 日本語 テスト, кошка и собака  \xa0 x \x1c y", "emoji 👩‍👩‍👧 ok",
         "a\n\n   b\t c \r\n d", "x" * 3000, "it's we'll don't\x85 z", "\x00 q \x7f", "same  ", "é ﻿ z ​ 　 w   u", " " * 50 + "end" + " " * 9,
         "日本語" * 400, "tab\t\ttab \t x", "same  "]


def plain_alignment(rows):
    """Whole texts through both tokenizers, one loop a group."""
    a_tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    alphabet = token_align.byte_alphabet()
    counts, docs = Counter(), []
    for doc, text in rows:
        groups = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text, num_threads=1)
            wa = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
            wb = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tok.id_to_piece(i)]]
            if b"".join(wa) == b"".join(wb) == (" " + text).encode():
                ends = [np.cumsum([len(w) for w in x]).tolist() for x in (wa, wb)]
                i = j = 0
                for end in sorted(set(ends[0]) & set(ends[1])):
                    ga, gb = [], []
                    while i < len(a) and ends[0][i] <= end:
                        ga.append(a[i])
                        i += 1
                    while j < len(b) and ends[1][j] <= end:
                        gb.append(b[j])
                        j += 1
                    groups.append((ga, gb))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        counts.update(links.keys())
        docs.append((doc, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return Counter(
        (d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()),
         sum(n for k, n in links.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in links.items()),
         hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else "")
        for d, g, links in docs)


def aligned(df):
    return Counter(tuple(r) for r in token_align.align(df, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)).collect())


def test_alignment_of_nasty_texts(spark):
    rows = [(i % 12 if i % 5 else None, t) for i, t in enumerate(NASTY)]
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, n_a int, codes binary").repartition(3)
    assert aligned(df) == plain_alignment(rows)


def test_alignment_of_documents(spark):
    df = read_table(spark, SF_CHECK, "documents").select("doc_id", "text")
    assert aligned(df.repartition(5)) == plain_alignment([tuple(r) for r in df.collect()])


def test_alignment_of_an_empty_table(spark):
    assert aligned(spark.createDataFrame([], "doc_id long, text string")) == Counter()


def test_small_numbers_come_back():
    for top in (0, 1, 255, 256, 70_000, 2**33):
        values = np.array([0, top, 3 % (top + 1)], np.int64)
        assert token_align._numbers(token_align._small(values), 3).tolist() == values.tolist()
    assert token_align._numbers(token_align._small(np.zeros(0, np.int64)), 0).tolist() == []


def test_blocks_take_little_memory():
    # a row passes through the JVM and two Python workers at its full size
    rng = random.Random(4)
    aligner = token_align.Aligner(*[open(public_tokenizers.path(x), "rb").read() for x in (TOKENIZER, PIECES)])
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 12))) for _ in range(20_000)]
    block = token_align.Block(aligner)
    for i in range(100):
        block.add(i, " ".join(rng.choices(words, k=1000)))
    assert block.row().nbytes < 1.6 * block.size


def test_few_blocks_a_file(spark, monkeypatch):
    monkeypatch.setattr(token_align, "BLOCK", 10)
    df = spark.createDataFrame([(i, f"the {i} texts of one block each") for i in range(10)], "doc_id long, text string").coalesce(1)
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/aligned-blocks-*"))
    out = token_align.align(df, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    assert out.count() == 10
    (made,) = set(glob.glob(f"{folder}/aligned-blocks-*")) - before
    rows = [pq.read_metadata(x).num_rows for x in glob.glob(f"{made}/*.parquet")]
    assert sum(rows) == 10 and max(rows) <= 4


def test_units_join_to_the_text(monkeypatch):
    aligner = token_align.Aligner(*[open(public_tokenizers.path(x), "rb").read() for x in (TOKENIZER, PIECES)])
    for size in (1, 3, 1 << 20):
        monkeypatch.setattr(token_align, "PIECE", size)
        for text in filter(None, NASTY):
            assert "".join(u for part in aligner.units(text) for u in part) == " " + text


# -- 13 approximate nearest neighbours ----------------------------------------

def exact(x: np.ndarray, ids: np.ndarray, query: int, k: int = 5):
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    s = u @ u[np.flatnonzero(ids == query)[0]]
    rest = np.flatnonzero(ids != query)
    return rest[np.lexsort((ids[rest], -s[rest]))[:k]], s


def test_recall_of_graph_search(spark):
    """Random directions in 32 dimensions: at least 0.9 of the true neighbours, exact scores."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 32))
    ids = np.arange(6000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    rows = nn_descent.neighbours(df, F.col("id") % 50 == 0).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 6000, 50)) and all([a for a, *_ in sorted(v)] == [1, 2, 3, 4, 5] for v in by.values())
    hits = 0
    for q, found in by.items():
        want, s = exact(x, ids, q)
        hits += len({v for _, v, _ in found} & set(ids[want].tolist()))
        assert np.allclose([c for *_, c in found], [s[v] for _, v, _ in found], atol=1e-12)
        assert sorted(found) == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hits >= 0.9 * 5 * len(by)


def test_nearest_with_copies_and_bad_vectors(spark):
    """A third of the rows are one vector; nulls, zeros and non-finite values take no part."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 8)).round(3)
    x[::3] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(1000, None), (1050, [0.0] * 8), (1100, [1.0, None] * 4), (1150, [float("nan")] * 8), (1200, [float("inf")] + [1.0] * 7), (1250, []), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + [(*b, 1) for b in bad] + rows[:10], "vec_id long, embedding array<double>, node int").repartition(3)
    got = defaultdict(list)
    for r in nn_descent.neighbours(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    assert set(got) == {0, 50, 100, 150, 200, 250}
    ids = np.arange(300)
    for q, found in got.items():
        want, s = exact(x, ids, q)
        assert [f[1] for f in found] == [round(float(s[w]), 9) for w in want]
        if q % 3 == 0:
            assert [f[0] for f in found] == [i for i in range(0, 30, 3) if i != q][:5]


def test_nearest_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert nn_descent.neighbours(spark.createDataFrame([], schema), F.col("id") % 50 == 0).collect() == []
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0, 0.0])], schema)
    rows = nn_descent.neighbours(df, F.col("id") % 50 == 0).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in rows] == [(1, 0.707107), (2, -1.0)]
    assert nn_descent.neighbours(df.limit(1), F.col("id") % 50 == 0).collect() == []
