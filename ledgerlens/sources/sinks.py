"""Sinks: results as JSON/parquet (S6) and report lines as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines a part of a report holds.
PART_LINES = 100_000


def write_results(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write any result table (metrics, raw rows) as JSON lines or parquet."""
    df.write.mode(mode).format(fmt).save(path)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite", part_lines: int = PART_LINES) -> None:
    """A (line_no, line) table as ordered text files, ``part_lines`` line
    numbers each, named by the range they hold: ``part=000000000012`` follows
    ``part=000000000011``. A part is one file, written by one task from a
    bounded number of lines; the text of all parts in the order of their names
    is the report. A null line is an empty one. Line numbers are unique and
    not negative."""
    part = F.lpad(F.expr(f"line_no div {int(part_lines)}").cast("string"), 12, "0")
    (lines.select("line_no", F.coalesce(F.col("line"), F.lit("")).alias("value"), part.alias("part"))
     .repartition(F.col("part")).sortWithinPartitions("part", "line_no")
     .select("value", "part").write.mode(mode).partitionBy("part").option("lineSep", "\n").text(path))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(part, at, line): the lines of a written report; ordered by ``part``,
    then ``at``, they are the report."""
    schema = "value string, part string"
    return spark.read.schema(schema).option("lineSep", "\n").text(path).select(
        "part", F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        F.col("value").alias("line"))
