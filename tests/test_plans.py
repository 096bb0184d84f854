"""Composite plans: evaluation run over a labelled file (L9) and the
cross-check of questions (L6)."""

import json

from pyspark.sql import functions as F

from ledgerlens.plans.crosscheck import cross_check
from ledgerlens.plans.evaluate import evaluate

from .test_claims import EVAL_CASES
from .test_routing import ROUTER_CASES


def _cases_file(tmp_path):
    doc = {
        "router_eval": [{"id": f"r{i}", "question": q, "expected_route": e} for i, (q, e) in enumerate(ROUTER_CASES)],
        "retrieval_eval": [],
        "csv_eval": [],
        "claim_eval": [{"id": f"cl{i:02d}", "claim": c, "csv_data": {col: vals}, "expected_verdict": exp, "note": ""}
                       for i, (c, col, vals, exp) in enumerate(EVAL_CASES)],
    }
    p = tmp_path / "cases.json"
    p.write_text(json.dumps(doc))
    return str(p)


def test_evaluation_run(spark, tmp_path):
    out = tmp_path / "out"
    report = {(r["suite"], r["slice"]): (r["value"], r["hits"], r["total"])
              for r in evaluate(spark, _cases_file(tmp_path), str(out)).collect()}
    assert report[("router", "all")] == (1.0, len(ROUTER_CASES), len(ROUTER_CASES))
    assert report[("claims", "all")] == (1.0, len(EVAL_CASES), len(EVAL_CASES))
    assert report[("retrieval", "all")] == (0.0, 0, 0)
    assert spark.read.json(str(out / "claims")).count() == len(EVAL_CASES)


def test_evaluation_run_with_retrieval_and_answers(spark, tmp_path):
    doc = {"router_eval": [], "csv_eval": [], "claim_eval": [],
           "retrieval_eval": [{"id": "r1", "question": "debt?", "expected_keywords": ["Debt"], "expected_page_contains": ""},
                              {"id": "r2", "question": "staff?", "expected_keywords": ["staff"], "expected_page_contains": ""}]}
    p = tmp_path / "cases.json"
    p.write_text(json.dumps(doc))
    corpus = spark.createDataFrame([(i, t, [float(i), 0.0]) for i, t in enumerate(["the debt fell", "b", "c", "d", "e", "f"])],
                                   "chunk_id long, text string, vector array<double>")
    vectors = spark.createDataFrame([("r1", [0.0, 0.0]), ("r2", [5.0, 0.0])], "id string, vector array<double>")
    answers = spark.createDataFrame([("r1", "It fell (Page 1)."), ("r2", "Unknown.")], "id string, answer string")
    report = {(r["suite"], r["slice"]): (r["hits"], r["total"])
              for r in evaluate(spark, str(p), None, corpus, vectors, answers).collect()}
    assert report[("retrieval", "all")] == (1, 2) and report[("citation", "all")] == (1, 2)
    assert report[("claims", "all")] == (0, 0)


def test_cross_check(spark):
    questions = spark.createDataFrame([(1, "Did revenue really grow?"), (2, "xyz")], "question_id long, question string")
    claims = spark.createDataFrame([(1, "Revenue increased by 5%"), (2, "Costs fell by 10%")],
                                   "claim_id long, claim string")
    metrics = spark.createDataFrame([(0, 1000.0, 200.0), (1, 1050.0, 180.0)], "_row_id long, revenue double, cost double")
    verdicts, evidence = cross_check(questions, claims, metrics, "_row_id")
    got = sorted((r["question_id"], r["claim_id"], r["verdict"]) for r in verdicts.collect())
    assert got == [(1, 1, "Supported"), (2, 1, "Supported"), (2, 2, "Supported")]
    assert evidence is None
