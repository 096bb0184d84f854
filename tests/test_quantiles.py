"""Exact quantiles by brackets against numpy, and what they shuffle."""

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import quantiles as Q

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


def test_equal_to_numpy(spark):
    rng = np.random.default_rng(5)
    data = {
        "wide": rng.normal(size=30_000) * 1e6, "ties": np.floor(rng.exponential(size=30_000) * 3),
        "one": np.full(30_000, 4.5), "hot": np.where(rng.random(30_000) < 0.6, 0.0, rng.random(30_000)),
    }
    import pandas as pd
    frame = pd.DataFrame(data)
    frame["gaps"] = np.where(rng.random(30_000) < 0.5, np.nan, frame["wide"])
    df = spark.createDataFrame(frame).withColumn("none", F.lit(None).cast("double")).repartition(16)
    got = Q.exact_quantiles(df, [*frame.columns, "none"], PROBS)
    for c in frame.columns:
        want = np.nanquantile(frame[c], PROBS)
        assert np.allclose([got[c, p] for p in PROBS], want, rtol=1e-12, atol=0), c
    assert all(got["none", p] is None for p in PROBS)


def test_shuffles_few_distinct_values(spark):
    df = spark.range(400_000).select((F.xxhash64("id") % 10_000_000).cast("double").alias("x"))
    counts = Q.bracket_counts(df, Q.brackets(df, ["x"], [0.25, 0.5, 0.75]))
    assert counts.count() < 0.05 * df.distinct().count()
    assert counts.agg(F.sum("n")).first()[0] == 400_000


def test_rank_outside_its_bracket_is_counted_whole(spark, monkeypatch):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2).cast("double").alias("y"))
    monkeypatch.setattr(Q, "brackets", lambda df, columns, probs: {"x": [(90.0, 95.0)], "y": [(90.0, 110.0)]})
    assert Q.exact_quantiles(df, ["x", "y"], [0.5]) == {("x", 0.5): 50.0, ("y", 0.5): 100.0}


def test_infinities_are_values(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),), (float("nan"),), (None,)], "x double")
    got = Q.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0])
    assert [got["x", p] for p in (0.0, 0.5, 1.0)] == [float("-inf"), 1.0, float("inf")]
