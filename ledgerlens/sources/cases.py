"""Labelled evaluation sets (S4): one JSON document with four arrays, or many.

``read_cases`` returns the four tables; the claim cases' ``csv_data`` (a map
column -> list of values) becomes a long table (case_id, metric, row_id, value)
so every claim case is verified against its own small metrics table by the
same DataFrame operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "router_eval array<struct<id string, question string, expected_route string>>, "
    "retrieval_eval array<struct<id string, question string, expected_keywords array<string>, "
    "expected_page_contains string>>, "
    "csv_eval array<struct<id string, question string, expected_keywords array<string>, expects_chart boolean>>, "
    "claim_eval array<struct<id string, claim string, csv_data map<string, array<double>>, "
    "expected_verdict string, note string>>"
)


def read_cases(spark: SparkSession, path: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """The tables of a file or folder. With ``multi_line`` each file is one
    document, read by one task; without it each line is one, with some of the
    arrays, so a large set is read by many tasks."""
    doc = spark.read.option("multiLine", multi_line).schema(SCHEMA).json(path)
    out = {name: doc.select(F.inline(name)) for name in
           ("router_eval", "retrieval_eval", "csv_eval", "claim_eval")}
    claims = out["claim_eval"]
    out["claim_values"] = (claims.select(F.col("id").alias("case_id"), F.explode("csv_data").alias("metric", "vals"))
                           .select("case_id", "metric", F.posexplode("vals").alias("row_id", "value")))
    return out
