"""Keyword router (C11), table-question intents (C12) and answers (L1), response cleaning."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import routing as R

ROUTER_CASES = [
    ("What does the document say?", "pdf"), ("What are the key risks in the report?", "pdf"),
    ("Summarize the main takeaways.", "pdf"), ("What are the financial highlights?", "pdf"),
    ("What does page 5 say about strategy?", "pdf"), ("Describe the narrative in the report.", "pdf"),
    ("What is the total revenue?", "csv"), ("What is the average ARR?", "csv"),
    ("What are the columns in the dataset?", "csv"), ("Which columns have missing values?", "csv"),
    ("What is the maximum MRR?", "csv"), ("What is the lowest ARR?", "csv"),
    ("Show revenue by region.", "csv"), ("Give me a summary of the dataset.", "csv"),
    ("Verify the revenue claim against the data.", "both"), ("Compare the report with the CSV.", "both"),
    ("Does the PDF match the spreadsheet?", "both"), ("Are the claims in the document consistent?", "both"),
    ("Validate the growth claim against the data.", "both"), ("Verify the total revenue claim.", "both"),
    ("This question has no matching keyword.", "pdf"), ("WHAT IS THE TOTAL REVENUE?", "csv"),
    ("How many rows are in the data?", "csv"), ("Which page mentions the CEO's statement?", "pdf"),
]


def test_router(spark):
    df = spark.createDataFrame([(i, q, e) for i, (q, e) in enumerate(ROUTER_CASES)],
                               "question_id long, question string, expected string")
    bad = R.route_questions(df).filter(F.col("route") != F.col("expected")).collect()
    assert bad == []


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(
        [("North", 10000.0, 120000.0, 10000.0, 10), ("South", 20000.0, 240000.0, 20000.0, 20),
         ("East", 15000.0, 180000.0, 15000.0, 15), ("West", 5000.0, 60000.0, 5000.0, 5)],
        "region string, revenue double, arr double, mrr double, customers long")


def _answer(spark, table, q):
    qs = spark.createDataFrame([(1, q)], "question_id long, question string")
    return R.answer_questions(qs, table).first()


def test_find_column(spark):
    df = spark.createDataFrame([("total revenue by region",), ("annual arr value",), ("completely unrelated",),
                                ("revenue arr mrr",)], "q string")
    got = [r[0] for r in df.select(R.find_column(F.col("q"), ["revenue", "arr"])).collect()]
    assert got == ["revenue", "arr", None, "revenue"]
    got = df.select(R.find_column(F.col("q"), ["annual_arr", "mrr"])).collect()[1][0]
    assert got == "annual_arr"


@pytest.mark.parametrize("q,intent,needle", [
    ("Give me a summary", "summary", "rows"),
    ("What are the columns?", "columns", "revenue"),
    ("What are the numeric columns?", "columns", "revenue"),
    ("What is the total revenue?", "total", "50,000.00"),
    ("What is the average revenue?", "average", "12,500.00"),
    ("What is the highest revenue?", "max", "20,000.00"),
    ("What is the lowest revenue?", "min", "5,000.00"),
    ("Are there missing values?", "missing", "no missing"),
    ("xyz completely unrecognised question", "help", "basic csv questions"),
])
def test_answers(spark, sample, q, intent, needle):
    r = _answer(spark, sample, q)
    assert r["intent"] == intent
    assert needle in r["answer"].lower()


def test_grouped_answer(spark, sample):
    r = _answer(spark, sample, "Show revenue by region")
    assert r["intent"] == "grouped"
    assert [(g["key"], g["value"]) for g in r["groups"]] == [
        ("South", 20000.0), ("East", 15000.0), ("North", 10000.0), ("West", 5000.0)]


def test_missing_answer(spark):
    t = spark.createDataFrame([(1000.0, "A"), (None, None), (3000.0, "C")], "revenue double, region string")
    r = _answer(spark, t, "Which columns have missing values?")
    assert r["answer"] == "Missing Values:\n- revenue: 1\n- region: 1\n"


def test_total_falls_back_to_all_columns(spark, sample):
    r = _answer(spark, sample, "What is the total of everything?")
    assert r["answer"].startswith("Totals for numeric columns:\n- revenue: 50,000.00\n")


def test_clean_responses(spark):
    rows = [
        (1, "What is the total revenue?", '{"intent": "CSV", "confidence": 0.9, "reasoning": "numbers"}'),
        (2, "What is the total revenue?", '```json\n{"intent": "both", "confidence": 1.7}\n```'),
        (3, "What is the total revenue?", '{"intent": "banana"}'),
        (4, "What does the report say?", "not json at all"),
        (5, "Verify the claim", '{"intent": "pdf", "confidence": "high"}'),
        (6, "What is the total revenue?", '["pdf"]'),
    ]
    df = spark.createDataFrame(rows, "id long, question string, raw string")
    got = {r["id"]: (r["intent"], r["confidence"], r["reasoning"]) for r in R.clean_route_responses(df).collect()}
    assert got[1] == ("csv", 0.9, "numbers")
    assert got[2] == ("both", 1.0, "")
    assert got[3] == ("csv", 0.8, "")
    assert got[4] == ("pdf", 0.5, "Keyword fallback (LLM parse error).")
    assert got[5] == ("both", 0.5, "Keyword fallback (LLM parse error).")
    assert got[6][1] == 0.5
