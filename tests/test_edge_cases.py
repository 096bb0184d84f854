"""Empty inputs give empty (or zero) results, never errors."""

from ledgerlens.operators import chunking as C
from ledgerlens.operators import claims as CL
from ledgerlens.operators import dense, lexical
from ledgerlens.operators import distribution as D
from ledgerlens.operators import profile as P
from ledgerlens.operators import stats as S


def test_empty_inputs(spark):
    pages = spark.createDataFrame([], "doc_id long, page_number int, text string")
    claims = spark.createDataFrame([], "claim_id long, claim string")
    metrics = spark.createDataFrame([(0, "2024-q1", 1.0), (1, "2024-q2", 2.0)],
                                    "_row_id long, period string, revenue double")
    no_rows = spark.createDataFrame([], "_row_id long, period string, revenue double")
    assert C.chunk_pages(pages).count() == 0
    assert CL.extract_claims(pages).count() == 0
    assert CL.verify(claims, metrics, "_row_id").count() == 0
    one = spark.createDataFrame([(1, "Revenue grew 5%")], "claim_id long, claim string")
    assert CL.verify(one, no_rows, "_row_id").first()["verdict"] == "Unverifiable"
    idx = lexical.build_index(spark.createDataFrame([], "chunk_id long, text string"))
    qs = spark.createDataFrame([(1, "x")], "question_id long, question string")
    assert lexical.lexical_topk(idx, qs, 3).count() == 0
    corpus = spark.createDataFrame([], "chunk_id long, vector array<float>")
    qv = spark.createDataFrame([(1, [1.0, 2.0])], "question_id long, vector array<float>")
    assert dense.nearest(corpus, qv, 3).count() == 0
    h = D.histogram(no_rows, "revenue").collect()
    assert len(h) == 25 and sum(r["count"] for r in h) == 0
    assert D.box_summary(no_rows, "revenue").first()["n"] == 0
    assert P.numeric_summary(no_rows).first()["count"] == 0
    assert S.normalised_series(no_rows, "revenue", "_row_id").count() == 0
