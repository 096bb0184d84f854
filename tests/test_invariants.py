"""Results do not depend on how the input is partitioned."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import claims as CL
from ledgerlens.operators import lexical

TEXTS = [
    "Revenue increased by 20% in 2023. Costs declined by 5%.\nProfit grew by 35% in Q3.",
    "Revenue increased by 20% in 2023. Sales doubled from 1999 to 2001. Nothing here.",
    "ARR grew 30% in FY2023. Churn halved this year. Up 5%.",
] * 7


@pytest.mark.parametrize("parts", [1, 8])
def test_extract_and_verify_partition_independent(spark, parts):
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(TEXTS)],
                                  "doc_id long, page_number int, text string").repartition(parts)
    claims = CL.extract_claims(pages)
    got = sorted(tuple(r) for r in claims.collect())
    base = sorted(tuple(r) for r in CL.extract_claims(pages.coalesce(1)).collect())
    assert got == base and len(got) == 7 * 7
    metrics = spark.createDataFrame(
        [(i, f"{2020 + i // 4}-q{i % 4 + 1}", 100.0 + 7 * i, 50.0 - i) for i in range(16)],
        "_row_id long, period string, revenue double, cost double").repartition(parts)
    c = claims.select((F.col("doc_id") * 100 + F.col("claim_id")).alias("claim_id"), "claim")
    v = sorted(tuple(r) for r in CL.verify(c, metrics, "_row_id").collect())
    v1 = sorted(tuple(r) for r in CL.verify(c.coalesce(1), metrics.coalesce(1), "_row_id").collect())
    assert v == v1


@pytest.mark.parametrize("parts", [1, 8])
def test_bm25_partition_independent(spark, parts):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string").repartition(parts)
    qs = spark.createDataFrame([(1, "revenue increased"), (2, "churn halved in q3")], "question_id long, question string")
    got = sorted(tuple(r) for r in lexical.lexical_topk(lexical.build_index(chunks), qs, 5).collect())
    base = sorted(tuple(r) for r in lexical.lexical_topk(lexical.build_index(chunks.coalesce(1)), qs, 5).collect())
    assert got == base and len(got) == 10
