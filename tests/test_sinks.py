"""Sinks: results as JSON (S6) and the report as one ordered text file."""

import glob

from pyspark.sql import functions as F

from ledgerlens.operators import report as RP
from ledgerlens.sources.sinks import read_report, write_report, write_results


def test_write_results_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "id long, s string, v double")
    write_results(df, str(tmp_path / "res"))
    back = sorted(tuple(r) for r in spark.read.schema("id long, s string, v double").json(str(tmp_path / "res")).collect())
    assert back == [(1, "a", 0.5), (2, "b", None)]


def test_write_report_keeps_line_order(spark, tmp_path):
    table = spark.createDataFrame([(i, float(i)) for i in range(30)], "_row_id long, revenue double")
    lines = RP.report_lines("today", None, table, None)
    want = [r["line"] for r in lines.orderBy("line_no").collect()]
    write_report(lines, str(tmp_path / "report"))
    files = sorted(glob.glob(str(tmp_path / "report" / "part=*" / "part-*")))
    got = [ln for f in files for ln in open(f, encoding="utf-8").read().split("\n")][:len(want)]
    assert got == want
    assert got[0] == "# Executive Report"


def test_a_long_report_has_many_parts_in_order(spark, tmp_path):
    n = 1_000_000
    lines = spark.range(n).select(F.col("id").alias("line_no"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("row "), "id")).alias("line"))
    path = str(tmp_path / "report")
    write_report(lines.orderBy(F.rand(3)), path, part_lines=50_000)
    files = sorted(glob.glob(path + "/part=*/part-*"))
    assert len(files) == 20
    text = "".join(open(f, encoding="utf-8").read() for f in files).split("\n")[:-1]
    assert text == [f"row {i}" if i % 7 else "" for i in range(n)]
    back = [r["line"] for r in read_report(spark, path).orderBy("part", "at").limit(120_000).collect()]
    assert back == text[:120_000]
