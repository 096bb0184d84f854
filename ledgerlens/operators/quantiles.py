"""Exact quantiles of any number of columns (used by P7 median and A17 quartiles).

A mergeable sketch first gives, per column and quantile, two values of the
column that the rank lies between (its error is bounded by ``1 / ACCURACY`` of
the rows; the brackets are twice as wide on either side). A second pass counts
every value inside the brackets exactly, and of those outside only how many lie
in each gap, all with partial sums, so the shuffle carries the brackets' few
distinct values. The counts prove where a rank lies: were it in a gap, that
column would be counted whole instead. What is left is range-partitioned by
column and value and written once; the totals per partition (a few numbers
each) tell in which partition a rank lies, and a running sum inside that
partition finds its value. NaN counts as missing; infinities are ordinary values.
Quantiles interpolate linearly between the two neighbouring ranks (the pandas,
Spark ``percentile`` and DuckDB ``quantile_cont`` rule).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ACCURACY = 2000  # the sketch's rank error is at most 1 / ACCURACY of the rows


def _value(column: str) -> Column:
    v = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(v), v)


def brackets(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[tuple[float, float]]]:
    """Disjoint value intervals per column, ascending, that hold its quantiles."""
    ends = [min(1.0, max(0.0, p + side * 2 / ACCURACY)) for p in probs for side in (-1, 1)]
    found = df.agg(*[F.percentile_approx(_value(c), ends, ACCURACY).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    out: dict[str, list[tuple[float, float]]] = {}
    for i, c in enumerate(columns):
        e, joined = found[f"e{i}"] or [], []
        for lo, hi in sorted(zip(e[::2], e[1::2])):
            if joined and lo <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(hi, joined[-1][1]))
            else:
                joined.append((lo, hi))
        out[c] = joined
    return out


def bracket_counts(df: DataFrame, within: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(c, g, v, n): ``n`` rows of column number ``c`` with the value ``v`` in
    the bracket of odd number ``g``, or with any value in the gap of even number ``g``."""
    cells = []
    for i, (c, intervals) in enumerate(within.items()):
        v = _value(c)
        g = F.lit(0) if not intervals else None
        for k, (lo, hi) in enumerate(intervals):
            g = F.when(v < lo, 2 * k) if g is None else g.when(v < lo, 2 * k)
            g = g.when(v <= hi, 2 * k + 1)
        g = g.otherwise(2 * len(intervals)) if intervals else g
        cells.append(F.struct(F.lit(i).alias("c"), g.cast("int").alias("g"), v.alias("v")))
    return (df.select(F.inline(F.array(*cells))).filter("v is not null")
            .groupBy("c", "g", F.when(F.col("g") % 2 == 1, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[tuple[str, float], float | None]:
    """Quantiles per (column, prob); None for columns without values."""
    if not columns or not probs:
        return {(c, p): None for c in columns for p in probs}
    out, missed = _select(df, brackets(df, columns, probs), probs)
    if missed:  # a rank outside its bracket: counted whole
        out |= _select(df, {c: [(float("-inf"), float("inf"))] for c in missed}, probs)[0]
    return out


def _select(df: DataFrame, within: dict[str, list[tuple[float, float]]], probs: list[float]):
    """The quantiles, and the columns with a rank that lies in none of its brackets."""
    columns = list(within)
    out: dict[tuple[str, float], float | None] = {(c, p): None for c in columns for p in probs}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = cut_lineage(bracket_counts(df, within).repartitionByRange(parts, "c", "g", "v")
                         .withColumn("part", F.spark_partition_id()), "quantiles")
    # brackets, partitions and columns bound these numbers
    totals = ranged.groupBy("c", "g", "part").agg(F.sum("n").alias("n")).orderBy("c", "g", "part").collect()
    spots: set[tuple[int, int, int, int]] = set()
    plan, missed = {}, set()
    for i, c in enumerate(columns):
        own = [(r["g"], r["part"], r["n"]) for r in totals if r["c"] == i]
        size = sum(n for _, _, n in own)
        for p in probs if size else ():
            place = p * (size - 1)
            plan[c, p] = (i, math.floor(place), math.ceil(place), place)
            for rank in plan[c, p][1:3]:
                below = 0
                for g, part, n in own:
                    if rank < below + n:
                        plan[i, rank] = (i, g, part, rank - below)
                        if g % 2:
                            spots.add(plan[i, rank])
                        else:
                            missed.add(c)
                        break
                    below += n
    if not spots:
        return out, missed
    upto = F.sum("n").over(Window.partitionBy("c", "g", "part").orderBy("v"))
    asked = df.sparkSession.createDataFrame(sorted(spots), "c int, g int, part int, rank long")
    keys = ["c", "g", "part"]
    ends = (ranged.join(F.broadcast(asked.select(*keys).distinct()), keys, "left_semi")
            .withColumn("upto", upto).join(F.broadcast(asked), keys).filter("rank < upto"))
    value = {(r["c"], r["g"], r["part"], r["rank"]): r["v"]
             for r in ends.groupBy(*keys, "rank").agg(F.min("v").alias("v")).collect()}
    for c, p in out:
        if (c, p) in plan and c not in missed:
            i, lo, hi, place = plan[c, p]
            a, b = value[plan[i, lo]], value[plan[i, hi]]
            out[c, p] = a if lo == hi or a == b else a + (b - a) * (place - lo)
    return out, missed
