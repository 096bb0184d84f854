"""Chunking invariants (C1, T4, F1) and the distributed running offsets."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import chunking as C
from ledgerlens.operators.ordering import with_row_index


def _pages(spark, texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)],
                                 "doc_id long, page_number int, text string")


def _chunks(spark, texts, size=800, overlap=150):
    return [r.asDict() for r in C.chunk_pages(_pages(spark, texts), size, overlap).orderBy("chunk_id").collect()]


def python_chunks(pages, size, overlap):
    out = []
    for doc, page, text in pages:
        if not text or text.strip() == "":
            continue
        start = 0
        while start < len(text):
            out.append((doc, page, text[start:start + size]))
            start = start + size - overlap
    return out


def test_basic(spark):
    assert len(_chunks(spark, ["A" * 2000])) > 1


def test_keys_and_pages(spark):
    got = _chunks(spark, ["Text on page 1.", "Text on page 2."], 100, 10)
    assert {c["page_number"] for c in got} == {1, 2}
    assert {"chunk_id", "page_number", "text"} <= set(got[0])


def test_blank_pages_skipped(spark):
    got = _chunks(spark, ["", "   \n\t", "Real content " * 20])
    assert all(c["page_number"] == 3 for c in got)


def test_invalid_overlap(spark):
    with pytest.raises(ValueError):
        C.chunk_pages(_pages(spark, ["X" * 1000]), 100, 100)


def test_sequential_ids_and_overlap(spark):
    got = _chunks(spark, ["A" * 2000], 500, 50)
    assert [c["chunk_id"] for c in got] == list(range(len(got)))
    text = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 40
    got = _chunks(spark, [text], 100, 20)
    assert got[0]["text"][-20:] == got[1]["text"][:20]


def test_short_page_single_chunk(spark):
    assert len(_chunks(spark, ["Short text."])) == 1


def test_matches_python_over_many_documents(spark):
    rows = [(d, p, ("word%d " % d) * (d * 37 % 400) if (d + p) % 7 else "")
            for d in range(30) for p in range(1, 4)]
    pages = spark.createDataFrame(rows, "doc_id long, page_number int, text string").repartition(5)
    got = C.chunk_pages(pages, 120, 30).orderBy("chunk_id").collect()
    want = python_chunks(sorted(rows), 120, 30)
    assert [(r["doc_id"], r["page_number"], r["text"]) for r in got] == want
    assert [r["chunk_id"] for r in got] == list(range(len(want)))
    # chunk_index restarts per document
    for d in {r["doc_id"] for r in got}:
        idx = [r["chunk_index"] for r in got if r["doc_id"] == d]
        assert idx == list(range(len(idx)))


def test_ranges_are_not_sampled_from_the_texts(spark, monkeypatch):
    seen = []
    offset = C.with_running_offset
    monkeypatch.setattr(C, "with_running_offset", lambda df, *a: seen.append(df.columns + df.inputFiles()) or offset(df, *a))
    assert len(_chunks(spark, ["A" * 1300, "", "b"])) == 3
    assert seen[0][:3] == ["doc_id", "page_number", "n_chunks"] and len(seen[0]) > 3  # read from files, no longer cut from the texts


def test_corpus_counts(spark):
    got = C.corpus_counts(_pages(spark, ["A" * 1300, ""]), 800, 150).first()
    assert got["pages"] == 2
    assert got["chunks"] == 2
    assert got["characters"] == (16 + 1 + 1300) + (16 + 1)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_row_index_independent_of_partitions(spark, parts):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(parts)
    assert with_row_index(df, ["k"], "i", num_partitions=parts).filter(F.col("i") != F.col("k")).count() == 0
