"""CSV metrics-table source.

Header row; every field read as a string, quoted fields may hold separators,
line breaks and doubled quotes; pandas' default null tokens become null; then
one aggregation decides the type of all columns at once:

* long when every non-null value is a whole number and the column has one,
  double when every one is a number (decimal, exponent, infinity; codes such
  as ``1d`` or ``0x1F`` are text);
* boolean (neither numeric nor categorical) when no value is missing and all
  are one of the fixed spellings of true and false; with a missing value such
  a column stays text.

Dates are never inferred: they stay strings, so period text such as '2025-01'
is categorical and window filters stay substring tests. ``order_col`` numbers
the rows by file name, then by place in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_row_index
from ..session import cut_lineage
from .csv_records import csv_records

# pandas' default strings read as missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TRUE_WORDS, FALSE_WORDS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def _number(x):
    """The double a field stands for, else null. Infinities are spelled out, as
    the cast knows fewer spellings of them."""
    low = F.lower(F.trim(x))
    inf = F.when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(x.rlike(NUMBER), F.when(low.contains("inf"), inf).otherwise(F.trim(x).try_cast("double")))


def _unused(name: str, taken: list[str]) -> str:
    """``name``, made longer until no column of the file has it."""
    low = {t.lower() for t in taken}
    while name in low:
        name += "_"
    return name


def read_metrics(spark: SparkSession, path: str, order_col: str = "_row_id", multi_line: bool = True) -> DataFrame:
    """One metrics table from a CSV file or a folder of them, all with the same header.

    Files are split between tasks. With ``multi_line`` quoted fields may hold
    line breaks (``csv_records`` finds where records start); False spares that
    when no field does.

    The file is parsed once: its rows are kept as text in the shared folder,
    which both the types and the row numbers are taken from."""
    options = {"sep": ",", "quote": '"', "escape": '"', "multiLine": str(multi_line).lower()}
    plain = spark.read.options(**options).option("header", True).option("inferSchema", False).csv(path)
    cols = plain.columns
    place = [_unused(n, cols + [order_col]) for n in ("_file", "_block", "_at")]
    if multi_line:
        parsed = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(cols))), options).alias("fields")
        raw = csv_records(spark, path).filter(~F.col("first")).select(parsed, "file", "block", "at")
    else:
        raw = plain.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("fields"),
                           F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                           F.monotonically_increasing_id().alias("at"))
    fields, spot = [F.col(f"fields.c{i}") for i in range(len(cols))], ["file", "block", "at"]
    clean = cut_lineage(raw.select(*[F.when(x.isin(NULL_TOKENS), F.lit(None)).otherwise(x).alias(c) for x, c in zip(fields, cols)],
                                   *[F.col(x).alias(n) for x, n in zip(spot, place)]), "csv")
    checks = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        checks += [F.count(x).alias(f"n{i}"),
                   F.count(_number(x)).alias(f"d{i}"),
                   F.count(F.when(x.rlike(WHOLE), F.trim(x).try_cast("long"))).alias(f"l{i}"),
                   F.count_if(x.isin(TRUE_WORDS + FALSE_WORDS)).alias(f"b{i}")]
    stats = clean.agg(*checks).first()
    out = []
    for i, c in enumerate(cols):
        n, d, ln, b = (stats[f"{k}{i}"] for k in "ndlb")
        x = F.col(f"`{c}`")
        if n > 0 and ln == n:
            out.append(F.trim(x).try_cast("long").alias(c))
        elif n > 0 and d == n:
            out.append(_number(x).alias(c))
        elif b > 0 and b == stats["rows"]:
            out.append(x.isin(TRUE_WORDS).alias(c))
        else:
            out.append(x.alias(c))
    numbered = with_row_index(clean.select(*place), place, order_col)
    return clean.select(*out, *place).join(numbered, place).drop(*place)
