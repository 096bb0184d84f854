"""Claim extraction, parsing, column matching and verification."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import claims as CF
from ledgerlens.operators import claims as CL


def _pages(spark, text):
    return spark.createDataFrame([(1, 1, text)], "doc_id long, page_number int, text string")


def _claims(spark, text):
    return [r["claim"] for r in CL.extract_claims(_pages(spark, text)).orderBy("claim_id").collect()]


@pytest.mark.parametrize("text,n", [
    ("Revenue increased by 20% this quarter.", 1),
    ("Costs declined by 10% year on year.", 1),
    ("Revenue increased significantly this year.", 0),
    ("Revenue was 20% of total sales.", 0),
    ("Revenue increased by 20%. Revenue increased by 20%.", 1),
    ("Revenue increased by 20%. Costs declined by 5%. Profit grew by 35%.", 3),
    ("Up 5%.", 0),
])
def test_extract_counts(spark, text, n):
    assert len(_claims(spark, text)) == n


def test_extract_keeps_percent_and_caps(spark):
    assert "20%" in _claims(spark, "Revenue increased by 20% this quarter.")[0]
    many = " ".join(f"Metric{i} grew by {i + 5}%." for i in range(20))
    got = [r["claim"] for r in CL.extract_claims(_pages(spark, many), 8).orderBy("claim_id").collect()]
    assert len(got) == 8
    assert len(_claims(spark, many)) == 20  # no cap unless one is asked for
    assert got[0].startswith("Metric0")


def test_extract_first_upper_and_dedup_by_whitespace(spark):
    got = _claims(spark, "revenue  increased by 20%.\nRevenue increased by 20%.")
    assert got == ["Revenue  increased by 20%."]


def _change(spark, text):
    r = spark.createDataFrame([(text,)], "c string").select(CF.change(F.col("c")).alias("x")).first()["x"]
    return r["pct"], r["direction"], r["tolerance"], r["mode"]


@pytest.mark.parametrize("text,pct,direction,tol,mode", [
    ("Revenue increased by 20%", 20.0, "increase", 5.0, None),
    ("Costs declined by 7.5%", 7.5, "decrease", 5.0, None),
    ("Revenue grew significantly", None, None, 5.0, None),
    ("Revenue was 15% of total", 15.0, None, 5.0, None),
    ("Revenue doubled last year", 100.0, "increase", 20.0, None),
    ("Users tripled in Q3", 200.0, "increase", 25.0, None),
    ("Churn halved this year", 50.0, "decrease", 10.0, None),
    ("Revenue more than doubled", 100.0, "increase", 0.0, "more_than_doubled"),
    ("Sales nearly doubled", 100.0, "increase", 30.0, None),
])
def test_change(spark, text, pct, direction, tol, mode):
    got = _change(spark, text)
    assert got[1:] == (direction, tol, mode)
    assert got[0] == pct if pct is None else abs(got[0] - pct) < 1e-9


def test_decimal_percent(spark):
    assert abs(_change(spark, "ARR grew by 3.14%")[0] - 3.14) < 1e-9


def _match(spark, claim, cols):
    r = spark.createDataFrame([(claim,)], "c string").select(CL.match_column(F.col("c"), cols).alias("m")).first()
    return r["m"]["column"], r["m"]["score_pct"] / 100.0, r["m"]["method"]


@pytest.mark.parametrize("claim,cols,col,method", [
    ("revenue increased by 20%", ["revenue", "profit"], "revenue", "exact"),
    ("sales grew by 10%", ["revenue", "profit"], "revenue", "business-term"),
    ("monthly recurring revenue grew 5%", ["mrr", "arr"], "mrr", None),
    ("nps improved by 10%", ["nps_score", "revenue"], "nps_score", "business-term"),
    ("net promoter score increased by 5%", ["nps_score", "revenue"], "nps_score", "business-term"),
    ("headcount grew 15%", ["headcount", "revenue"], "headcount", None),
    ("employees grew by 10%", ["headcount", "revenue"], "headcount", None),
    ("churn declined by 8%", ["churn_rate_pct", "revenue"], "churn_rate_pct", "business-term"),
    ("total revenue grew by 20%", ["revenue_usd_thousands", "revenue", "arr"], "revenue_usd_thousands",
     "business-term"),
    ("total revenue increased by 5%", ["revenue_usd_thousands", "revenue"], "revenue_usd_thousands", None),
])
def test_column_match(spark, claim, cols, col, method):
    got = _match(spark, claim, cols)
    assert got[0] == col
    if method:
        assert got[2] == method
    assert got[1] >= 0.8


def test_fuzzy_and_none(spark):
    col, score, method = _match(spark, "revenu increased", ["revenue", "profit"])
    assert col == "revenue" and score > 0 and method.startswith("fuzzy(")
    col, score, method = _match(spark, "completely unrelated text xyz", ["revenue"])
    assert col is None and score == 0.0 and method == "none"


def test_alias_tier(spark):
    # column 'revenue_total' starts with canonical 'revenue'; 'turnover' is an alias
    col, score, method = _match(spark, "turnover rose 4%", ["revenue_total", "profit"])
    assert (col, score, method) == ("revenue_total", 0.9, "alias")


@pytest.mark.parametrize("text,window", [
    ("Revenue grew 20% in Q3", ("quarter", 3)),
    ("Costs declined 10% in H1", ("half", 1)),
    ("ARR increased 30% in 2023", ("year", 2023)),
    ("Revenue grew by 20%", None),
    ("Revenue grew 20% from FY2024 to 2025", None),
    ("ARR increased 15% from Q1 2024 to Q4 2024", None),
    ("Revenue grew 20% in 2025", ("year", 2025)),
    ("ARR grew 30% in FY2023", ("year", 2023)),
])
def test_time_window(spark, text, window):
    r = spark.createDataFrame([(text,)], "c string").select(CF.time_window(F.col("c")).alias("w")).first()["w"]
    assert (None if r is None else (r["type"], r["value"])) == window


EVAL_CASES = [
    ("Revenue increased by 5%", "revenue", [1000, 1010, 1020, 1050], "Supported"),
    ("Revenue increased by 50%", "revenue", [1000, 1010, 1020, 1050], "Contradicted"),
    ("Revenue decreased by 5%", "revenue", [1000, 1010, 1020, 1050], "Contradicted"),
    ("Profit grew by 20%", "profit", [100, 110, 115, 120], "Supported"),
    ("Sales declined by 10%", "sales", [200, 190, 185, 180], "Supported"),
    ("ARR increased by 30%", "arr", [1000, 1100, 1200, 1300], "Supported"),
    ("Revenue increased by 10%", "revenue", [1000, 900], "Contradicted"),
    ("Cost reduced by 15%", "cost", [200, 185, 175, 170], "Supported"),
    ("Expenses grew by 25%", "expenses", [100, 110, 120, 125], "Supported"),
    ("Revenue increased by 5%", "revenue", [0, 100, 200], "Unverifiable"),
    ("Revenue increased by 5%", "irrelevant_col", [10, 20], "Unverifiable"),
    ("Profit increased by 100%", "profit", [100, 150, 180, 200], "Supported"),
    ("MRR grew by 40%", "mrr", [100, 120, 130, 140], "Supported"),
    ("Sales increased by 200%", "sales", [100, 200, 250, 300], "Supported"),
    ("Revenue decreased by 50%", "revenue", [1000, 500], "Supported"),
    ("Cost reduced by 15%", "cost", [200, 170], "Supported"),
    ("Earnings grew by 20%", "profit", [100, 120], "Supported"),
    ("Revenue increased by 5%", "revenue", [1000], "Unverifiable"),
]


def _verify(spark, claim, col, vals):
    m = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], f"_row_id long, {col} double")
    c = spark.createDataFrame([(1, claim)], "claim_id long, claim string")
    return CL.verify(c, m, "_row_id").first()


@pytest.mark.parametrize("claim,col,vals,expected", EVAL_CASES)
def test_verdicts(spark, claim, col, vals, expected):
    r = _verify(spark, claim, col, vals)
    assert r["verdict"] == expected
    assert 0.0 <= r["confidence"] <= 1.0


def test_verdict_batch_equals_single(spark):
    """Many claims against many one-metric tables in one job: same verdicts."""
    rows = [(i, c, col, v, exp) for i, (c, col, v, exp) in enumerate(EVAL_CASES)]
    got = {}
    for i, c, col, vals, exp in rows:
        got[i] = _verify(spark, c, col, vals)["verdict"]
    assert [got[i] for i, *_ in rows] == [r[4] for r in rows]


def test_no_numeric_columns(spark):
    m = spark.createDataFrame([(0, "a"), (1, "b")], "_row_id long, name string")
    c = spark.createDataFrame([(1, "Revenue increased by 5%")], "claim_id long, claim string")
    r = CL.verify(c, m, "_row_id").first()
    assert r["verdict"] == "Unverifiable" and r["reason"].startswith("No numeric columns")


def test_result_fields_and_reason(spark):
    r = _verify(spark, "Revenue grew 5%", "revenue", [1000, 1050])
    for key in ["claim", "verdict", "csv_metric", "actual_percent", "first_val", "last_val", "reason",
                "confidence", "window_type", "window_value", "match_method"]:
        assert key in r.asDict()
    assert r["reason"] == ("Claim: 5.0% increase in 'revenue'. Actual: +5.00% (from 1,000.00 to 1,050.00). "
                           "Column matched via exact.")
    assert r["confidence"] == 0.9


def test_time_window_kept_and_filter(spark):
    r = _verify(spark, "Revenue increased by 5% in Q3", "revenue", [1000, 1050])
    assert (r["window_type"], r["window_value"]) == ("quarter", 3)
    m = spark.createDataFrame(
        [(0, "2024-q2", 100.0), (1, "2024-q3", 200.0), (2, "2025-q3", 210.0), (3, "2025-q4", 500.0)],
        "_row_id long, quarter string, revenue double")
    c = spark.createDataFrame([(1, "Revenue increased by 5% in Q3")], "claim_id long, claim string")
    r = CL.verify(c, m, "_row_id").first()
    assert r["verdict"] == "Supported"
    assert r["reason"].startswith("Filtered to QUARTER 3 (2 rows). ")
    assert r["confidence"] == 1.0


def test_sample_table_first_to_last(spark):
    from ledgerlens.sources.metrics_csv import read_metrics
    import os
    path = os.path.join(os.path.dirname(__file__), "fixtures", "sample_metrics.csv")
    m = read_metrics(spark, path)
    c = spark.createDataFrame([(1, "Revenue decreased by 75%")], "claim_id long, claim string")
    r = CL.verify(c, m, "_row_id").first()
    assert r["first_val"] == 380000.0 and r["last_val"] == 94000.0
    assert round(r["actual_percent"], 2) == -75.26
    assert r["verdict"] == "Supported"


def test_tally_reports_all_verdicts(spark):
    v = spark.createDataFrame([("Supported",), ("Supported",)], "verdict string")
    got = {r["verdict"]: r["count"] for r in CL.tally(v).collect()}
    assert got == {"Supported": 2, "Contradicted": 0, "Unverifiable": 0}


def test_relevant_claims_with_fallback(spark):
    q = spark.createDataFrame([(1, "what about revenue growth"), (2, "nothing here xyz")],
                              "question_id long, question string")
    c = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["Revenue grew 5%", "Costs fell 2%", "Profit rose 3%", "Orders up 1%", "Seats up 9%"], start=1)],
        "claim_id long, claim string")
    got = CL.relevant_claims(q, c, 4).collect()
    q1 = sorted(r["claim_id"] for r in got if r["question_id"] == 1)
    q2 = sorted(r["claim_id"] for r in got if r["question_id"] == 2)
    assert q1 == [1]
    assert q2 == [1, 2, 3, 4]


def test_relevant_claims_plan_and_inner_words(spark):
    """A word may lie inside a longer token, and no nested loop is planned."""
    q = spark.createDataFrame([(1, "venue (costs)"), (2, None), (3, "a of %%%%")], "question_id long, question string")
    c = spark.createDataFrame([(1, "Revenues grew 5%"), (2, "The (costs)\tfell 2%"), (3, None), (2, "The (costs)\tfell 2%")],
                              "claim_id long, claim string")
    out = CL.relevant_claims(q, c, 1)
    got = sorted((r["question_id"], r["claim_id"], r["fallback"]) for r in out.collect())
    assert got == [(1, 1, False), (1, 2, False), (2, 1, True), (3, 1, True)]
    words = CL.question_words(q)
    plan = CL._words_in_tokens(words, c.selectExpr("claim as token"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
