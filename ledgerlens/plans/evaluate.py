"""An evaluation run over a labelled-set file (S4 -> C11 / L5 -> A20-A24 -> S6).

Claim cases each carry their own small metric table (``csv_data``), of any
columns. All of them are one table of cells, and all claims are verified in one
job: nothing is collected and no loop runs over cases or schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dense
from ..operators import evaluation as E
from ..operators import many_tables as MT
from ..operators import routing as R
from ..operators.ordering import with_row_index
from ..sources.cases import read_cases
from ..sources.sinks import write_results

RETRIEVED = 4  # chunks a retrieval case gets


def verify_cases(claim_cases: DataFrame, claim_values: DataFrame) -> DataFrame:
    """(id, verdict, csv_metric, actual_percent) for every claim case that has a table."""
    # a case's columns in the order of their names; its tables need not share a schema
    cells = claim_values.select(F.col("case_id").alias("table_id"), "row_id", F.col("metric").alias("ordinal"),
                                F.col("metric").alias("column"), F.lit(True).alias("numeric"), "value",
                                F.col("value").cast("string").alias("text"))
    claims = (claim_cases.join(claim_values.select(F.col("case_id").alias("id")).distinct(), "id", "left_semi")
              .select(F.col("id").alias("table_id"), F.lit(1).cast("long").alias("claim_id"), "claim"))
    return MT.verify_tables(claims, cells).select(F.col("table_id").alias("id"), "verdict", "csv_metric", "actual_percent")


def retrieve_cases(cases: DataFrame, corpus: DataFrame, vectors: DataFrame, k: int = RETRIEVED) -> DataFrame:
    """(question_id, rank, text): the ``k`` nearest chunks of every retrieval case.
    ``corpus``: (chunk_id, text, vector); ``vectors``: (id, vector) of the questions."""
    numbered = with_row_index(cases.select("id").distinct(), ["id"], "question_id")  # the search takes long ids
    hits = dense.nearest(corpus.select("chunk_id", "vector"), numbered.join(vectors, "id").select("question_id", "vector"), k)
    return hits.join(corpus.select("chunk_id", "text"), "chunk_id").join(numbered, "question_id").select(
        F.col("id").alias("question_id"), F.col("dense_rank").alias("rank"), "text")


def evaluate(spark: SparkSession, cases_path: str, out_path: str | None = None, corpus: DataFrame | None = None,
             vectors: DataFrame | None = None, answers: DataFrame | None = None, multi_line: bool = True) -> DataFrame:
    """The report over a labelled-set file. Retrieval runs when ``corpus``
    (chunk_id, text, vector) and the questions' ``vectors`` (id, vector) are
    given, citation when ``answers`` (id, answer) are; without them these parts
    are 0 of 0. ``multi_line=False`` reads a large set of one document a line."""
    t = read_cases(spark, cases_path, multi_line)
    routed = R.route_questions(t["router_eval"]).select(
        "id", "expected_route", F.col("route").alias("actual_route"))
    verdicts = verify_cases(t["claim_eval"], t["claim_values"])
    claims = E.expected_vs_actual(t["claim_eval"].select("id", "expected_verdict"),
                                  verdicts.select("id", F.col("verdict").alias("actual_verdict")), "id")
    asked = t["retrieval_eval"]
    if corpus is not None and vectors is not None:
        hits = retrieve_cases(asked, corpus, vectors)
        expected = asked.select(F.col("id").alias("question_id"), F.col("expected_keywords").alias("keywords"))
    else:
        hits = spark.createDataFrame([], "question_id string, rank int, text string")
        expected = spark.createDataFrame([], "question_id string, keywords array<string>")
    if answers is None:
        answers = spark.createDataFrame([], "id string, answer string")
    answered = asked.select("id").join(answers.select("id", "answer"), "id")
    report = E.evaluation_report(E.route_accuracy(routed), E.hit_at_k(hits, expected),
                                 E.citation_rate(answered), E.verdict_accuracy(claims))
    if out_path:
        write_results(report, out_path + "/metrics")
        write_results(routed, out_path + "/router")
        write_results(claims, out_path + "/claims")
    return report
