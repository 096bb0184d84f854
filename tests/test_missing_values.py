"""NaN is a missing value; no column is hidden or cut off; long series keep their peaks."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import distribution as D
from ledgerlens.operators import evaluation as E
from ledgerlens.operators import profile as P
from ledgerlens.operators import stats as S

NAN = float("nan")


@pytest.fixture(scope="module")
def with_nan(spark):
    return spark.createDataFrame([(1, NAN, "a"), (2, 1.0, "a"), (3, 2.0, "b"), (4, 3.0, "b")], "id int, x double, g string")


def test_nan_in_statistics(with_nan):
    x = with_nan.select("x")
    assert [S.column_stat(x, f).first()["value"] for f in ("sum", "mean", "max", "min", "count")] == [6.0, 2.0, 3.0, 1.0, 3.0]
    assert tuple(S.metric_cards(x).first())[2:] == (6.0, 3)
    assert tuple(S.key_metrics(x).first())[2:] == (6.0, 2.0, 3.0)
    row = P.profile(x).first()
    assert (row["non_null"], row["missing"]) == (3, 1)
    assert {r["g"]: r["x"] for r in S.grouped(with_nan, "g", "x").collect()} == {"a": 1.0, "b": 5.0}
    assert P.column_samples(with_nan, "id").filter("column = 'x'").first()["samples"] == ["1.0", "2.0", "3.0"]


def test_nan_in_distributions(with_nan):
    assert D.histogram(with_nan, "x", 2).agg(F.sum("count")).first()[0] == 3
    assert D.box_summary(with_nan, "x").first()["whisker_high"] == 3.0
    assert [r["y"] for r in S.normalised_series(with_nan, "x", "id").orderBy("position").collect()] == [0.0, 0.5, 1.0]


def test_no_column_is_hidden_or_cut(spark):
    df = spark.createDataFrame([tuple(range(12))], ", ".join(f"{'_' if i % 2 else ''}c{i} int" for i in range(12)))
    names = [f"{'_' if i % 2 else ''}c{i}" for i in range(12)]
    for out in (P.profile(df), P.numeric_summary(df), S.metric_cards(df), S.key_metrics(df), S.column_stat(df, "sum")):
        assert [r["column"] for r in out.orderBy("ordinal").collect()] == names
    assert P.numeric_columns(df.withColumn("_row_id", F.lit(1))) == names


@pytest.mark.parametrize("distinct", [1, 2, 50, 51, 400])
def test_chart_categoricals_at_the_limit(spark, distinct):
    rows = [(f"v{i % distinct}", None if i % 3 else "x", "one" if i % 2 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "a string, b string, _c string").repartition(7)
    got = {r["column"]: r["n_unique"] for r in P.chart_categoricals(df, 50).collect()}
    assert got == ({"a": distinct} if 1 < distinct <= 50 else {})


@pytest.mark.parametrize("rows,points", [(1000, 40), (41, 40), (40, 40), (3, 4), (1000, 7)])
def test_series_points_keep_every_peak(spark, rows, points):
    rng = random.Random(rows)
    values = [rng.choice([0.0, 1.0, rng.random(), -5.0 if i == rows // 2 else 2.0]) for i in range(rows)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(5)
    got = {r["position"]: r["value"] for r in S.series_points(S.normalised_series(df, "v", "i"), points).collect()}
    n = points // 4
    want = set(range(rows)) if rows <= points else set()
    for part in range(n) if rows > points else ():
        own = [i for i in range(rows) if int(i * n / rows) == part]
        want |= {own[0], own[-1], min(own, key=lambda i: (values[i], i)), max(own, key=lambda i: (values[i], -i))}
    assert got == {i: values[i] for i in want} and len(got) <= max(points, 4 * n)


def test_a_class_named_all(spark):
    df = spark.createDataFrame([("all", "all"), ("pdf", "csv"), ("pdf", "csv")], "expected_route string, actual_route string")
    got = sorted((r["slice"], r["hits"], r["total"]) for r in E.route_accuracy(df).collect())
    assert got == [("all", 1, 1), ("all", 1, 3), ("pdf", 0, 2)]
