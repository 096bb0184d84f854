"""Evaluation metrics (A20-A24) and the labelled-set source."""

import json

from ledgerlens.operators import evaluation as E
from ledgerlens.sources.cases import read_cases


def test_route_accuracy(spark):
    r = spark.createDataFrame([("pdf", "pdf"), ("pdf", "csv"), ("csv", "csv"), ("both", "both")],
                              "expected_route string, actual_route string")
    got = {x["slice"]: (x["value"], x["hits"], x["total"]) for x in E.route_accuracy(r).collect()}
    assert got == {"all": (0.75, 3, 4), "pdf": (0.5, 1, 2), "csv": (1.0, 1, 1), "both": (1.0, 1, 1)}


def test_empty_sets_give_zero(spark):
    r = spark.createDataFrame([], "expected_route string, actual_route string")
    got = E.route_accuracy(r).collect()
    assert [(x["slice"], x["value"], x["total"]) for x in got] == [("all", 0.0, 0)]
    a = spark.createDataFrame([], "answer string")
    assert E.citation_rate(a).first()["value"] == 0.0


def test_citation_and_hits(spark):
    a = spark.createDataFrame([("Revenue grew (Page 3).",), ("no cite",), ("see (page  12) here",)], "answer string")
    assert E.citation_rate(a).first()["hits"] == 2
    hits = spark.createDataFrame([(1, 1, "Revenue grew"), (1, 2, "costs"), (2, 1, "nothing")],
                                 "question_id long, rank int, text string")
    exp = spark.createDataFrame([(1, ["REVENUE"]), (2, ["risk"]), (3, ["x"])], "question_id long, keywords array<string>")
    r = E.hit_at_k(hits, exp).first()
    assert (r["hits"], r["total"]) == (1, 3)


def test_verdict_f1(spark):
    r = spark.createDataFrame([("Supported", "Supported"), ("Supported", "Contradicted"),
                               ("Unverifiable", "Unverifiable")], "expected_verdict string, actual_verdict string")
    got = {x["verdict"]: (x["precision"], x["recall"], x["f1"]) for x in E.verdict_f1(r).collect()}
    assert got["Supported"] == (1.0, 0.5, 2 / 3)
    assert got["Contradicted"] == (0.0, 0.0, 0.0)
    assert got["Unverifiable"] == (1.0, 1.0, 1.0)


def test_read_cases(spark, tmp_path):
    doc = {"router_eval": [{"id": "r01", "question": "What does the PDF say?", "expected_route": "pdf"}],
           "retrieval_eval": [{"id": "ret01", "question": "risks?", "expected_keywords": ["risk"],
                               "expected_page_contains": "risk"}],
           "csv_eval": [{"id": "csv01", "question": "summary", "expected_keywords": ["rows"], "expects_chart": False}],
           "claim_eval": [{"id": "cl01", "claim": "Revenue increased by 5%",
                           "csv_data": {"revenue": [800, 820, 810, 840]}, "expected_verdict": "Supported",
                           "note": "x"}]}
    p = tmp_path / "cases.json"
    p.write_text(json.dumps(doc, indent=2))
    t = read_cases(spark, str(p))
    assert t["router_eval"].count() == 1
    vals = [r["value"] for r in t["claim_values"].orderBy("row_id").collect()]
    assert vals == [800.0, 820.0, 810.0, 840.0]
