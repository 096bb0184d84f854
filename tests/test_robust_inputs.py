"""Inputs that stopped or bent a job: NaN, wide ranges, digits of other scripts, nulls."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import claims as CF
from ledgerlens.operators import dense, evaluation, profile, quantiles, routing


@pytest.mark.parametrize("values,median", [
    ([1e-300, 1e-9, 0.1, 5.0, 1e300], 0.1), ([0.0, 0.05, 0.1, 7.0, math.inf], 0.1), ([math.nan, 1.0, 2.0, 3.0], 2.0),
    ([4.0, 4.0, 4.0, 1.0], 4.0), ([None, 1.0, 2.0], 1.5), ([None, math.nan], None)])
def test_exact_median(spark, values, median):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    assert quantiles.exact_quantiles(df, ["x"], [0.5])["x", 0.5] == median


def test_numeric_summary_skips_nan(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,), (2.0,), (3.0,)], "x double")
    r = profile.numeric_summary(df).first()
    assert (r["count"], r["mean"], r["median"], r["max"]) == (3, 2.0, 2.0, 3.0)


def test_digits_of_other_scripts(spark):
    df = spark.createDataFrame([("Revenue rose ٢٠%",), ("in 20४५ it fell 5%",)], "claim string")
    got = df.select(CF.change(F.col("claim"))["pct"], CF.time_window(F.col("claim"))["value"]).collect()
    assert [tuple(r) for r in got] == [(20.0, None), (5.0, 2045)]


def test_null_vectors(spark):
    corpus = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [None, 1.0])], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "question_id long, vector array<double>")
    assert [(r[0], r[1]) for r in dense.nearest(corpus, asked).select("question_id", "chunk_id").collect()] == [(1, 1)]


def test_null_label_is_no_total(spark):
    df = spark.createDataFrame([("a", "a"), (None, "a")], "expected_route string, actual_route string")
    got = {r["slice"]: (r["hits"], r["total"]) for r in evaluation.route_accuracy(df).collect()}
    assert got == {"all": (1, 2), "a": (1, 1), "unlabelled": (0, 1)}


def test_json_nulls(spark):
    replies = ['{"intent": null, "confidence": 0.9}', '{"intent": "csv", "confidence": null}', '{"intent": "CSV"}', "{}"]
    df = spark.createDataFrame([("hello", r) for r in replies], "question string, raw string").withColumn("kw", routing.route(F.col("question")))
    got = {r["raw"]: (r["intent"] == r["kw"], r["intent"], r["confidence"]) for r in routing.clean_route_responses(df).collect()}
    assert got[replies[0]][0] and got[replies[0]][2] == 0.9
    assert got[replies[1]][0] and got[replies[1]][2] == 0.5
    assert got[replies[2]][1:] == ("csv", 0.8) and got[replies[3]][1:] == ("pdf", 0.8)
