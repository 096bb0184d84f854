"""Distribution tables behind the dashboard charts.

Bounds (min, max, quartiles, count, std) are one-row scalar subqueries that
Catalyst runs once and inlines; the data itself is scanned once more for the
binned counts. Nothing is pairwise: the density is evaluated on the 25 bin
counts, not on the raw values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import present_of


def _vals(df: DataFrame, metric: str) -> DataFrame:
    return df.select(present_of(df, metric).cast("double").alias("v")).filter(F.col("v").isNotNull())


def histogram(df: DataFrame, metric: str, bins: int = 25) -> DataFrame:
    """Equal-width bins over [min, max]; the max value goes to the last bin;
    empty bins are reported with count 0."""
    v = _vals(df, metric)
    b = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, hi = b.select("lo").scalar(), b.select("hi").scalar()
    width = hi - lo
    bin_expr = F.least(
        F.floor(F.when(width == 0, F.lit(0.0)).otherwise((F.col("v") - lo) / width * bins))
        .cast("long") + 1, F.lit(bins))
    counts = v.select(bin_expr.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = v.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin",
                    (lo + (F.col("bin") - 1) * width / bins).alias("lo"),
                    (lo + F.col("bin") * width / bins).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def box_summary(df: DataFrame, metric: str) -> DataFrame:
    """Quartiles (linear interpolation), whiskers = extreme values inside
    the 1.5*IQR fences, and the number of points outside them."""
    from .quantiles import exact_quantiles

    v = _vals(df, metric)
    qs = exact_quantiles(v, ["v"], [0.25, 0.5, 0.75])
    q1, med, q3 = (F.lit(qs[("v", p)]).cast("double") for p in (0.25, 0.5, 0.75))
    iqr = q3 - q1
    lo_f, hi_f = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    # scalar subqueries stay in a projection; aggregates read plain columns
    v = v.select("v", ((F.col("v") >= lo_f) & (F.col("v") <= hi_f)).alias("_in"))
    inside = F.col("_in")
    return v.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    ).select("n", q1.alias("q1"), med.alias("median"), q3.alias("q3"),
             "whisker_low", "whisker_high", "outliers")


def density_grid(df: DataFrame, metric: str, points: int = 64, bins: int = 25) -> DataFrame:
    """Gaussian kernel density on ``points`` evenly spaced x in [min, max],
    computed from the A16 bin counts (binned KDE). Bandwidth: 1.06 * std * n^-1/5.
    """
    v = _vals(df, metric)
    s = v.agg(F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("n"),
              F.min("v").alias("lo"), F.max("v").alias("hi"))
    sd, n = s.select("sd").scalar(), s.select("n").scalar()
    lo, hi = s.select("lo").scalar(), s.select("hi").scalar()
    h = F.lit(1.06) * sd * F.pow(n.cast("double"), F.lit(-0.2))
    hist = histogram(df, metric, bins).filter(F.col("count") > 0) \
        .select(((F.col("lo") + F.col("hi")) / 2).alias("center"), "count")
    # every non-empty bin meets every grid point: bins * points rows, both fixed
    pairs = hist.select("center", "count",
                        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = lo + F.col("point") * (hi - lo) / (points - 1)
    z = (x - F.col("center")) / h
    kern = pairs.select("point", (F.col("count") * F.exp(-0.5 * z * z)).alias("_kv"))
    return (kern.groupBy("point").agg(F.sum("_kv").alias("_k"))
            .select("point", (lo + F.col("point") * (hi - lo) / (points - 1)).alias("x"),
                    (F.col("_k") / (n * h * math.sqrt(2 * math.pi))).alias("density")))
