"""Lexical BM25 against a brute-force reimplementation, exact k-NN, fusion order."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import q_text
from ledgerlens.sources.pages import pages_from_documents
from ledgerlens.functions.text import tokens
from ledgerlens.operators import dense, fusion, lexical

TEXTS = ["Revenue grew by 20% this year. Total ARR reached 1 million.",
         "Operating costs declined significantly. Profit margins improved.",
         "Customer acquisition cost fell by 15%. Retention rate increased.",
         "the the the revenue", "profit and revenue and costs", "", "margins margins margins"]


def brute_bm25(corpus, query, k1=1.5, b=0.75, eps=0.25):
    docs = [t.lower().split() for t in corpus]
    n = len(docs)
    avgdl = sum(len(d) for d in docs) / n
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    avg = sum(idf.values()) / len(idf)
    idf = {w: (eps * avg if v < 0 else v) for w, v in idf.items()}
    scores = []
    for d in docs:
        s = 0.0
        for q in query.lower().split():
            tf = d.count(q)
            s += idf.get(q, 0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avgdl))
        scores.append(s)
    return scores


@pytest.mark.parametrize("q", ["revenue", "profit margins", "the revenue revenue", "unknownword"])
def test_bm25_matches_brute_force(spark, q):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string")
    idx = lexical.build_index(chunks)
    qs = spark.createDataFrame([(1, q)], "question_id long, question string")
    got = {r["chunk_id"]: r["lexical_score"] for r in lexical.score(idx, qs).collect()}
    want = brute_bm25(TEXTS, q)
    q_terms = set(q.lower().split())
    for i, t in enumerate(TEXTS):
        if q_terms & set(t.lower().split()):
            assert abs(got[i] - want[i]) < 1e-9
        else:
            assert i not in got
    assert idx.n_docs == len(TEXTS)


def test_dense_topk_exact_and_capped(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(60, 8)).astype("float32")
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "chunk_id long, vector array<float>")
    qv = rng.normal(size=(5, 8)).astype("float32")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qv)], "question_id long, vector array<float>")
    got = dense.nearest(corpus.repartition(4), qs, 3).collect()
    for i, q in enumerate(qv.astype("float64")):
        d = ((vecs.astype("float64") - q) ** 2).sum(1)
        want = sorted(range(60), key=lambda j: (round(d[j], 6), j))[:3]
        mine = [r["chunk_id"] for r in sorted((r for r in got if r["question_id"] == i), key=lambda r: r["dense_rank"])]
        assert mine == want
    capped = dense.nearest(corpus.limit(2), qs.limit(1), 100).collect()
    assert len(capped) == 2


def test_fusion_scores_and_order(spark):
    d = spark.createDataFrame([(1, 10, 0.5, 1), (1, 11, 0.7, 2)],
                              "question_id long, chunk_id long, dense_distance double, dense_rank int")
    lx = spark.createDataFrame([(1, 12, 3.0, 1), (1, 10, 2.0, 2)],
                               "question_id long, chunk_id long, lexical_score double, lexical_rank int")
    got = fusion.fuse(d, lx, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [10, 11, 12]
    assert abs(got[0]["hybrid_score"] - (0.6 / 61 + 0.4 / 62)) < 1e-9
    assert got[2]["dense_distance"] is None


def test_relevance_labels(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (3.0,), (None,)], "d double")
    got = [r[0] for r in df.select(fusion.relevance_label(F.col("d"))).collect()]
    assert got == ["high relevance", "medium relevance", "low relevance", "unscored"]


def test_pages_cut_from_documents(spark):
    docs = spark.createDataFrame([(1, "abcdefg"), (2, None), (3, "")], "doc_id long, text string")
    got = [tuple(r) for r in pages_from_documents(docs, page_chars=3).orderBy("doc_id", "page_number").collect()]
    assert got == [(1, 1, "abc"), (1, 2, "def"), (1, 3, "g"), (2, 1, None), (3, 1, "")]


def test_dense_equal_vectors_give_k_rows_by_id(spark):
    corpus = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(99, [1.0])], "chunk_id long, vector array<double>")
    qs = spark.createDataFrame([(7, [1.0, 2.0])], "question_id long, vector array<double>")
    got = dense.nearest(corpus.repartition(5), qs, 3).orderBy("dense_rank").collect()
    assert [(r["chunk_id"], r["dense_distance"]) for r in got] == [(0, 0.0), (1, 0.0), (2, 0.0)]


@pytest.mark.parametrize("skip", [False, True])
def test_search_shuffles_no_pairs(spark, skip):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string")
    qs = spark.createDataFrame([(1, "revenue")], "question_id long, question string")
    plan = lexical.lexical_topk(lexical.build_index(chunks), qs, 3, skip=skip)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(question_id" in plan
    assert "hashpartitioning(question_id#" not in "".join(x for x in plan.splitlines() if "chunk_id" in x and "Exchange" in x)


def zipf_texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{min(int(x), 300)}" for x in rng.zipf(1.4, rng.integers(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("spread", [1, 1000])
def test_skipping_search_equals_full_scores(spark, spread):
    texts = zipf_texts(600, 3) + ["w1 w2"] * 30 + [None]
    chunks = spark.createDataFrame([(i * spread, t) for i, t in enumerate(texts)], "chunk_id long, text string").repartition(5)
    asked = [(i, f"w1 w2 w1 w{5 * i + 3} w{7 * i + 11}") for i in range(12)] + [(50, "w1"), (51, "unknown"), (None, "w9 w1"), (52, "w299 w298")]
    qs = spark.createDataFrame(asked, "question_id long, question string")
    index = lexical.build_index(chunks)
    full = lexical.top_k(lexical.score(index, qs), 5, "lexical_score", "lexical_rank", ascending=False)
    got = lexical.lexical_topk(index, qs, 5, skip=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, full.collect()))


def test_skipping_search_with_text_and_null_ids(spark):
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(zipf_texts(80, 5))] + [(None, "w3 w4")], "chunk_id string, text string")
    qs = spark.createDataFrame([(1, "w3 w4"), (2, "w1")], "question_id long, question string")
    index = lexical.build_index(chunks)
    full = lexical.top_k(lexical.score(index, qs), 4, "lexical_score", "lexical_rank", ascending=False)
    assert sorted(map(str, lexical.lexical_topk(index, qs, 4, skip=True).collect())) == sorted(map(str, full.collect()))


def test_negative_idf_and_more_asked_than_there_is(spark):
    # every term is in most chunks: the mean idf, and so every idf, is negative
    chunks = spark.createDataFrame([(i, "a b" if i % 7 else "a") for i in range(40)], "chunk_id long, text string")
    qs = spark.createDataFrame([(1, "a b"), (2, "b")], "question_id long, question string")
    index = lexical.build_index(chunks)
    for k in (3, 100):
        full = lexical.top_k(lexical.score(index, qs), k, "lexical_score", "lexical_rank", ascending=False)
        assert sorted(map(str, lexical.lexical_topk(index, qs, k, skip=True).collect())) == sorted(map(str, full.collect()))


def test_blocks_below_the_floor_are_not_scored(spark):
    # the rare word stands in a few blocks, the frequent one in all
    texts = [f"common filler{i % 50} filler{i % 37}" + (" rare" if i % 100 == 0 else "") for i in range(2000)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    qs = spark.createDataFrame([(1, "common rare")], "question_id long, question string")
    index = lexical.build_index(chunks)
    scored = lexical.best_scores(index, qs, 5).count()
    assert scored < 0.2 * lexical.score(index, qs).count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("skip", [False, True])
def test_search_groups_and_joins_no_pairs(spark, skip):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string")
    qs = spark.createDataFrame([(1, "revenue"), (2, "profit")], "question_id long, question string")
    plan = plan_of(lexical.lexical_topk(lexical.build_index(chunks), qs, 3, skip=skip))
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("skip", [False, True])
def test_repeated_chunk_ids_add_up(spark, skip):
    texts = zipf_texts(300, 9)
    rows = list(enumerate(texts)) + [(7, "w1 w2 w2"), (7, None), (9, "w1"), (None, "w2"), (None, "w2 w1")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(4)
    qs = spark.createDataFrame([(i, f"w1 w2 w{i}") for i in range(8)] + [(None, "w2"), (3, "w5 w5")], "question_id long, question string")
    index = lexical.build_index(chunks)
    full = lexical.top_k(lexical.score(index, qs), 6, "lexical_score", "lexical_rank", ascending=False)
    assert sorted(map(str, lexical.lexical_topk(index, qs, 6, skip=skip).collect())) == sorted(map(str, full.collect()))


def test_search_over_several_blocks(spark):
    texts = zipf_texts(9000, 11)
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").coalesce(1)
    qs = spark.createDataFrame([(i, f"w1 w2 w{i}") for i in range(20)], "question_id long, question string")
    index = lexical.build_index(chunks)
    assert index.blocks.count() > 2
    full = sorted(map(str, lexical.top_k(lexical.score(index, qs), 5, "lexical_score", "lexical_rank", ascending=False).collect()))
    for skip in (False, True):
        assert sorted(map(str, lexical.lexical_topk(index, qs, 5, skip=skip).collect())) == full


def test_document_counts_are_summed_before_they_are_shuffled():
    packed = list(lexical._pack(iter([pa.record_batch({"chunk_id": pa.array(ids), "tokens": pa.array(t, pa.list_(pa.string()))})
                                      for ids, t in (([1, 2], [["a", "b", "a"], None]), ([3], [["a"]]))])))
    assert [(p["n"][0].as_py(), p["total"][0].as_py()) for p in packed] == [(2, 3), (1, 1)]
    out = list(lexical._frequencies(iter([pa.record_batch({"data": p.column("data")}) for p in packed])))
    assert sorted((r["term"], r["df"]) for b in out for r in b.to_pylist()) == [("a", 2), ("b", 1)]


def test_words_are_cut_as_tokens_cut_them(spark):
    spaces = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    others = "aBß\x1c\x1f\u200b\u2011\u180e\ufeff\u4e2d\U0001f600\u0130"
    rng = np.random.default_rng(3)
    texts = [None, "", " ", spaces, others] + ["".join(rng.choice(list(spaces + others), rng.integers(14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    want = df.select("i", F.lower("text").alias("low"), F.coalesce(tokens(F.col("text")), F.array()).alias("w")).orderBy("i").collect()
    low = pa.array([r["low"] for r in want], pa.string())
    assert lexical._words(low).to_pylist() == [r["w"] for r in want]
    assert lexical._words(low.slice(100, 50)).to_pylist() == [r["w"] for r in want[100:150]]
    assert lexical._words(low.slice(0, 2)).to_pylist() == [[], []] and lexical._words(low.slice(0, 0)).to_pylist() == []


def test_index_reads_texts_and_not_token_lists(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "A b\u00a0a"), (2, None)], "chunk_id long, text string")
    monkeypatch.setattr(lexical, "tokens", None)
    index = lexical.build_index(chunks)
    assert (index.n_docs, index.total_tokens) == (2, 3)
    assert {r["term"]: r["df"] for r in index.terms.collect()} == {"a": 1, "b": 1}


def test_repeated_ids_are_counted_without_the_blocks(spark, monkeypatch):
    index = lexical.build_index(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e")], "chunk_id long, text string"))
    plans = []
    cut = lexical.cut_lineage
    monkeypatch.setattr(lexical, "cut_lineage", lambda df, name: plans.append(plan_of(df)) or cut(df, name))
    assert {r["chunk_id"] for r in index.repeated.collect()} == {None, 2}
    assert len(plans) == 1 and "MapInArrow" not in plans[0] and "data#" not in plans[0]


def test_chunks_are_written_once_for_both_corpora(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "a b " * 700), (2, "c"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, [1.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    cut = []
    chunks_of = q_text.doc_chunks
    monkeypatch.setattr(q_text, "doc_chunks", lambda *a: cut.append(1) or chunks_of(*a))
    chunks, _ = q_text.chunk_index(spark, str(tmp_path))
    corpus = q_text.hybrid_corpus(spark, str(tmp_path))
    assert len(cut) == 1 and corpus.count() == chunks.count() > 2


def test_dense_blocks_are_not_dealt_out(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vecs = np.round(rng.normal(size=(300, 3)), 1)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(400, [1.0]), (401, [2.0]), (402, None)],
                                  "chunk_id long, vector array<double>").repartition(3)
    for block in ("CORPUS_BLOCK", "QUESTION_BLOCK"):
        monkeypatch.setattr(dense, block, 17)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = dense.nearest(frame, frame.withColumnRenamed("chunk_id", "question_id"), 4)
        plan = plan_of(hits)
        assert "CartesianProduct" in plan and "hashpartitioning(dim" not in plan and "Generate" not in plan
        got = {(r["question_id"], r["dense_rank"]): r["chunk_id"] for r in hits.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for i, q in enumerate(vecs):
        d = np.round(((vecs - q) ** 2).sum(1), 6)
        assert [got[i, n] for n in range(1, 5)] == sorted(range(300), key=lambda j: (d[j], j))[:4]
    assert [got[400, n] for n in (1, 2)] == [400, 401] and (402, 1) not in got and (400, 3) not in got


def test_few_hits_meet_the_chunks_without_a_shuffle(spark):
    chunks = spark.createDataFrame([(i, i, 1, f"t{i}") for i in range(20)], "chunk_id long, doc_id long, page_number int, text string")
    hits = spark.createDataFrame([(1, 3, 1), (1, 5, 2)], "question_id long, chunk_id long, rank int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fusion.with_chunks(hits.repartition(3, "question_id"), chunks)
        assert "BroadcastHashJoin" in plan_of(got) and "SortMergeJoin" not in plan_of(got)
        assert sorted((r["rank"], r["text"]) for r in got.collect()) == [(1, "t3"), (2, "t5")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_hybrid_corpus_joins_vectors_to_first_chunks(spark, tmp_path):
    from ledgerlens.plans import q_text

    docs = [(1, "a b " * 700), (2, "c"), (3, None), (4, "d " * 1500)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    vectors = [(1, [1.0, 2.0]), (2, [3.0]), (2, [4.0]), (9, [5.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    chunks = q_text.doc_chunks(spark, str(tmp_path)).collect()
    want = [(c["chunk_id"], c["text"], v) for c in chunks
            for v in ([v for i, v in vectors if i == c["doc_id"] and c["chunk_index"] == 0] or [None])]
    corpus = q_text.hybrid_corpus(spark, str(tmp_path))
    assert sorted(map(str, ((r["chunk_id"], r["text"], r["vector"]) for r in corpus.collect()))) == sorted(map(str, want))
    others = [x for x in plan_of(corpus.filter("vector IS NULL")).splitlines() if "Exchange" in x]
    assert not others
