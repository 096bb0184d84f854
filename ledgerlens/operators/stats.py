"""Aggregations over a metrics table (A1-A10, A19, F8, T6, T7) and the typed
analysis entry point (L2).

pandas conventions kept: the sum of an all-null column is 0, ``groupby`` drops
null keys, std is the sample std, NaN is a missing value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import with_row_index
from .profile import _long, numeric_columns, present_of

_AGGS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "avg": F.avg,
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "count": F.count,
}


def _c(name: str):
    return F.col(f"`{name}`")


def column_stat(df: DataFrame, fn: str, columns: list[str] | None = None,
                value_name: str = "value") -> DataFrame:
    """A1-A4: one statistic for every numeric column (or the given ones), one pass."""
    cols = columns if columns is not None else numeric_columns(df)
    agg = _AGGS[fn]
    one = df.agg(*[agg(present_of(df, c)).alias(f"v{i}") for i, c in enumerate(cols)])
    return _long(one, [F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                                F.col(f"v{i}").cast("double").alias(value_name))
                       for i, c in enumerate(cols)])


def grouped(df: DataFrame, key: str, metric: str, fn: str = "sum",
            value_name: str | None = None) -> DataFrame:
    """A5/A6 without the cut: aggregate ``metric`` per non-null ``key``.

    Partial (map-side) aggregation runs before the shuffle, so a key holding a
    third of the rows arrives as one partial row per task.
    """
    name = value_name or metric
    return (df.filter(_c(key).isNotNull())
            .groupBy(_c(key).alias(key))
            .agg(_AGGS[fn](present_of(df, metric)).cast("double").alias(name)))


def grouped_top(df: DataFrame, key: str, metric: str, fn: str = "sum", n: int | None = 10,
                value_name: str | None = None) -> DataFrame:
    """A5: top ``n`` groups by aggregated value, descending, ties by key.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n and only those rows meet on one task.
    """
    name = value_name or metric
    out = grouped(df, key, metric, fn, name).orderBy(F.desc(name), F.asc(key))
    return out.limit(n) if n else out


def top_group(df: DataFrame, key: str, metric: str) -> DataFrame:
    """The group with the largest sum and its amount."""
    return grouped_top(df, key, metric, "sum", 1)


def share_of_total(top: DataFrame, value: str, out: str = "share") -> DataFrame:
    """Each shown group's share of the shown total (input is already cut to N rows)."""
    return top.withColumn(out, F.col(value) / F.sum(value).over(Window.partitionBy()))


def metric_cards(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Total and non-null count of every numeric column (of the first
    ``limit``, if a display asks for fewer)."""
    cols = numeric_columns(df)[:limit]
    one = df.agg(*[x for i, c in enumerate(cols)
                   for x in (F.coalesce(F.sum(present_of(df, c)), F.lit(0)).cast("double").alias(f"t{i}"),
                             F.count(present_of(df, c)).alias(f"n{i}"))])
    return _long(one, [F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                                F.col(f"t{i}").alias("total"), F.col(f"n{i}").alias("non_null"))
                       for i, c in enumerate(cols)])


def key_metrics(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Total, mean and max of every numeric column (of the first ``limit``,
    if a display asks for fewer)."""
    cols = numeric_columns(df)[:limit]
    one = df.agg(*[x for i, c in enumerate(cols)
                   for x in (F.coalesce(F.sum(present_of(df, c)), F.lit(0)).cast("double").alias(f"t{i}"),
                             F.avg(present_of(df, c)).alias(f"m{i}"),
                             F.max(present_of(df, c)).cast("double").alias(f"x{i}"))])
    return _long(one, [F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                                F.col(f"t{i}").alias("total"), F.col(f"m{i}").alias("mean"),
                                F.col(f"x{i}").alias("max"))
                       for i, c in enumerate(cols)])


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """A10: Pearson correlation of two metrics, over rows that have both."""
    return df.agg(F.corr(present_of(df, a).cast("double"), present_of(df, b).cast("double")).alias("correlation"))


_OPS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__"}


def row_filter(df: DataFrame, column: str, op: str, literal) -> DataFrame:
    """F8: rows where ``column <op> literal`` (pushed into the parquet scan)."""
    return df.filter(getattr(_c(column), _OPS[op])(F.lit(literal)))


def top_rows(df: DataFrame, metric: str, n: int = 10, tie_cols: list[str] | None = None) -> DataFrame:
    """The ``n`` rows with the largest ``metric`` (TakeOrderedAndProject)."""
    order = [F.desc_nulls_last(metric)] + [F.asc(c) for c in (tie_cols or [])]
    return df.orderBy(*order).limit(n)


def normalised_series(df: DataFrame, metric: str, order_col: str) -> DataFrame:
    """Non-null values of ``metric`` in row order, min-max scaled to [0,1] and
    evenly spaced on x in [0,1]. Fewer than two values -> no rows; zero range ->
    divisor 1.

    Positions come from the distributed prefix count (no global window); the
    min/max/count are one-row scalar subqueries.
    """
    vals = df.select(F.col(order_col).alias("_ord"), present_of(df, metric).cast("double").alias("value")) \
             .filter(F.col("value").isNotNull())
    stats = vals.agg(F.min("value").alias("lo"), F.max("value").alias("hi"),
                     F.count(F.lit(1)).alias("n"))
    lo = stats.select("lo").scalar()
    hi = stats.select("hi").scalar()
    n = stats.select("n").scalar()
    rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
    idx = with_row_index(vals, ["_ord"], "position")
    return (idx.filter(n >= 2)
            .select("position", "value",
                    (F.col("position") / (n - 1)).alias("x"),
                    ((F.col("value") - lo) / rng).alias("y")))


def series_points(series: DataFrame, points: int) -> DataFrame:
    """T7 for long series: at most ``points`` rows of a normalised series, so
    that a chart shows every peak.

    The positions fall into ``points // 4`` ranges of equal width; of each, the
    first, last, lowest and highest row stay (ties: the first). A range is one
    partial aggregate a task, so ``points`` rows a task are shuffled at most.
    A series of no more than ``points`` rows stays whole.
    """
    if points < 4:
        raise ValueError("a range keeps four rows: at least 4 points")
    ranges = points // 4
    n = series.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    row = F.struct("position", "value", "x", "y")
    by_value = F.struct(F.col("value").alias("v"), F.col("position").alias("p"), row.alias("row"))
    by_value_last = F.struct(F.col("value").alias("v"), (-F.col("position")).alias("p"), row.alias("row"))
    # the range of a row; in a series that stays whole, every row is its own
    part = F.when(n <= points, F.col("position")).otherwise(F.floor(F.col("position") * ranges / n))
    kept = series.withColumn("part", part).groupBy("part").agg(
        F.min(row).alias("first"), F.max(row).alias("last"),
        F.min(by_value).alias("low"), F.max(by_value_last).alias("high"))
    rows = F.array_distinct(F.array("first", "last", F.col("low.row"), F.col("high.row")))
    return kept.select(F.inline(rows))


def analyse(df: DataFrame, spec: dict) -> DataFrame:
    """L2: a typed analysis request instead of generated code.

    spec kinds: {"kind": "filter", "column", "op", "value"},
    {"kind": "top_rows", "metric", "n", "tie_cols"},
    {"kind": "grouped", "key", "metric", "fn", "n"},
    {"kind": "correlation", "a", "b"}.
    """
    kind = spec["kind"]
    if kind == "filter":
        return row_filter(df, spec["column"], spec["op"], spec["value"])
    if kind == "top_rows":
        return top_rows(df, spec["metric"], spec.get("n", 10), spec.get("tie_cols"))
    if kind == "grouped":
        return grouped_top(df, spec["key"], spec["metric"], spec.get("fn", "sum"), spec.get("n"))
    if kind == "correlation":
        return correlation(df, spec["a"], spec["b"])
    raise ValueError(f"unknown analysis kind: {kind}")


def truncate_rows(df: DataFrame, order_cols: list[str], limit: int = 20) -> DataFrame:
    """At most ``limit`` rows of a result, in a stated order."""
    return df.orderBy(*order_cols).limit(limit)
