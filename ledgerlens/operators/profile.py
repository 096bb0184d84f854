"""Profiling operators.

Rule used throughout: one scan, one ``agg`` for every column at once, then a
reshape of the single result row into long form with ``inline`` (no join, no
second scan). Column metadata comes from ``df.schema`` on the driver, which is
metadata, not data.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, NumericType, StringType

#: The row order that the CSV source adds; every other column is data, whatever its name.
ROW_ORDER = "_row_id"


def present(col: Column, dtype: DataType) -> Column:
    """The column with NaN read as missing, as a metrics table means it."""
    return F.nanvl(col, F.lit(None).cast(dtype)) if isinstance(dtype, (DoubleType, FloatType)) else col


def present_of(df: DataFrame, name: str) -> Column:
    return present(F.col(f"`{name}`"), df.schema[name].dataType)


def column_kind(dtype) -> str:
    if isinstance(dtype, BooleanType):
        return "other"
    if isinstance(dtype, NumericType):
        return "numeric"
    if isinstance(dtype, StringType):
        return "categorical"
    return "other"


def visible_fields(df: DataFrame):
    return [f for f in df.schema.fields if f.name != ROW_ORDER]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in visible_fields(df) if column_kind(f.dataType) == "numeric"]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in visible_fields(df) if column_kind(f.dataType) == "categorical"]


def column_kinds(df: DataFrame) -> DataFrame:
    """(column, ordinal, dtype, kind) from the schema."""
    rows = [(f.name, i, f.dataType.simpleString(), column_kind(f.dataType))
            for i, f in enumerate(visible_fields(df))]
    return df.sparkSession.createDataFrame(
        rows, "column string, ordinal int, dtype string, kind string")


def _long(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*structs)))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: dtype, kind, rows, non_null, missing.

    A single aggregation pass (count(*) plus count(c) per column) feeds all
    columns; at scale that is one partial aggregate per task and a one-row
    final merge.
    """
    fields = visible_fields(df)
    aggs = [F.count(F.lit(1)).alias("__rows")] + [
        F.count(present(F.col(f"`{f.name}`"), f.dataType)).alias(f"__nn{i}") for i, f in enumerate(fields)]
    one = df.agg(*aggs)
    structs = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(i).alias("ordinal"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(column_kind(f.dataType)).alias("kind"),
            F.col("__rows").alias("rows"),
            F.col(f"__nn{i}").alias("non_null"),
            (F.col("__rows") - F.col(f"__nn{i}")).alias("missing"),
        )
        for i, f in enumerate(fields)
    ]
    return _long(one, structs)


def dataset_summary(df: DataFrame) -> DataFrame:
    """P2/P3 totals: rows, columns, numeric and categorical name lists."""
    fields = visible_fields(df)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(fields)).cast("long").alias("columns"),
        F.lit(", ".join(numeric_columns(df))).alias("numeric_columns"),
        F.lit(", ".join(categorical_columns(df))).alias("categorical_columns"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with nulls, most missing first (ties in schema order)."""
    return (profile(df).filter(F.col("missing") > 0)
            .select("column", "ordinal", "missing")
            .orderBy(F.desc("missing"), "ordinal"))


def missing_total(df: DataFrame) -> DataFrame:
    """P4 grand total of nulls over all cells."""
    return profile(df).agg(F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("missing_total"))


def column_listing(df: DataFrame, kind: str | None = None) -> DataFrame:
    """P5: all / numeric / categorical columns with their types and non-null counts."""
    out = profile(df)
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    return out.select("column", "ordinal", "dtype", "kind", "non_null")


def column_samples(df: DataFrame, order_col: str, n: int = 3) -> DataFrame:
    """The first ``n`` non-null values of every column in row order.

    The table is unpivoted to (column, ord, value) and ranked per column.
    ``row_number() <= n`` becomes a WindowGroupLimit that keeps n rows per
    column inside each task before the shuffle, so a column (a group holding
    1/ncols of all rows) never lands whole on one task.
    """
    fields = visible_fields(df)
    pairs = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("ordinal"),
                 present(F.col(f"`{f.name}`"), f.dataType).cast("string").alias("value"))
        for i, f in enumerate(fields)])
    long = (df.select(F.col(order_col).alias("_ord"), F.inline(pairs))
            .filter(F.col("value").isNotNull()))
    w = Window.partitionBy("column").orderBy("_ord")
    firsts = long.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return (firsts.groupBy("column", "ordinal")
            .agg(F.array_sort(F.collect_list(F.struct("_rn", "value"))).alias("_s"))
            .select("column", "ordinal",
                    F.transform("_s", lambda s: s["value"]).alias("samples")))


def numeric_summary(df: DataFrame, columns: list[str] | None = None,
                    limit: int | None = None, exact_median: bool = True) -> DataFrame:
    """Count, mean, median, min, max, sample std of every numeric column
    (of the first ``limit``, if a display asks for fewer).

    One aggregation gives count/mean/min/max/std of all columns (NaN counts as
    missing); exact medians come from ``quantiles``. ``exact_median=False``
    uses ``percentile_approx`` in the first pass instead.
    """
    from .quantiles import exact_quantiles

    cols = (columns or numeric_columns(df))[:limit]
    aggs = []
    for i, c in enumerate(cols):
        x = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.stddev_samp(x).alias(f"s{i}")]
        if not exact_median:
            aggs.append(F.percentile_approx(x, 0.5, 100000).cast("double").alias(f"m{i}"))
    one = df.agg(*aggs)
    if exact_median:
        first = one.first()
        med = exact_quantiles(df, cols, [0.5])
        # the one-row result is already known: rebuild it without a rescan
        one = df.sparkSession.createDataFrame([first], schema=one.schema).select(
            "*", *[F.lit(med[(c, 0.5)]).cast("double").alias(f"m{i}") for i, c in enumerate(cols)])
    return _long(one, [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"),
                 F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
                 F.col(f"m{i}").alias("median"), F.col(f"lo{i}").alias("min"),
                 F.col(f"hi{i}").alias("max"), F.col(f"s{i}").alias("std"))
        for i, c in enumerate(cols)])


def chart_categoricals(df: DataFrame, max_unique: int = 50) -> DataFrame:
    """Categorical columns with 1 < distinct non-null values <= max_unique.

    One pass. A task holds at most ``max_unique + 1`` values of a column, which
    is enough to know that a column has more; those few rows are shuffled and
    counted exactly. A column with more values than that sends as many from every task,
    whatever its number of distinct values.
    """
    cats = categorical_columns(df)
    if not cats:
        return df.sparkSession.createDataFrame([], "column string, ordinal int, n_unique long")
    ordinals = {f.name: i for i, f in enumerate(visible_fields(df))}

    def run(batches):
        seen: list[set[str]] = [set() for _ in cats]
        for batch in batches:
            for values, column in zip(seen, batch.columns, strict=True):
                if len(values) <= max_unique:
                    new = column.unique().drop_null().to_pylist()
                    values.update(new[:max_unique + 1])
        rows = [(i, v) for i, values in enumerate(seen) for v in values]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], names=["at", "value"])

    counts = (df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cats)]).mapInArrow(run, "at int, value string")
              .groupBy("at").agg(F.count_distinct("value").alias("n_unique")))
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(ordinals[c]).alias("ordinal")) for c in cats])
    return (counts.filter((F.col("n_unique") > 1) & (F.col("n_unique") <= max_unique))
            .select(names[F.col("at")].alias("c"), "n_unique").select("c.column", "c.ordinal", "n_unique"))
