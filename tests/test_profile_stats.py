"""CSV source, profiling and statistics on the sample metrics table."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import distribution as D
from ledgerlens.operators import profile as P
from ledgerlens.operators import report as RP
from ledgerlens.operators import stats as S
from ledgerlens.sources.metrics_csv import read_metrics

PATH = os.path.join(os.path.dirname(__file__), "fixtures", "sample_metrics.csv")


@pytest.fixture(scope="module")
def sample(spark):
    return read_metrics(spark, PATH)


def test_csv_types_no_date_inference(sample):
    types = dict((f.name, f.dataType.simpleString()) for f in sample.schema.fields)
    assert types["month"] == "string" and types["region"] == "string"
    assert types["revenue"] == "bigint" and types["mrr"] == "bigint"
    assert P.numeric_columns(sample) == ["revenue", "arr", "mrr", "customers", "seats"]
    assert P.categorical_columns(sample) == ["month", "region"]


def test_csv_null_tokens(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("a,b,c\n1,x,2.5\nNA,,n/a\n3,null,4\n")
    df = read_metrics(spark, str(p))
    rows = df.orderBy("_row_id").collect()
    assert [r["a"] for r in rows] == [1, None, 3]
    assert [r["b"] for r in rows] == ["x", None, None]
    assert [r["c"] for r in rows] == [2.5, None, 4.0]


def test_numeric_summary(sample):
    got = {r["column"]: r for r in P.numeric_summary(sample).collect()}
    r = got["revenue"]
    assert (r["count"], r["min"], r["max"], r["median"]) == (18, 65000.0, 480000.0, 138500.0)
    assert round(r["mean"], 2) == 214277.78 and round(r["std"], 2) == 157007.23
    assert round(got["mrr"]["median"], 1) == 461666.5


def test_profile_and_missing(spark):
    t = spark.createDataFrame([(1000.0, "A"), (None, None), (3000.0, "C")], "revenue double, region string")
    got = {r["column"]: r["missing"] for r in P.profile(t).collect()}
    assert got == {"revenue": 1, "region": 1}
    assert [r["column"] for r in P.missing_report(t).collect()] == ["revenue", "region"]
    assert P.missing_total(t).first()[0] == 2


def test_grouped_and_top(sample):
    got = [(r["region"], r["revenue"]) for r in S.grouped_top(sample, "region", "revenue").collect()]
    assert got == [("North America", 2550000.0), ("EMEA", 833000.0), ("APAC", 474000.0)]
    top = S.top_group(sample, "region", "revenue").first()
    assert top["region"] == "North America"
    share = S.share_of_total(S.grouped_top(sample, "region", "revenue"), "revenue").collect()
    assert abs(sum(r["share"] for r in share) - 1.0) < 1e-12


def test_column_stats(sample):
    tot = {r["column"]: r["value"] for r in S.column_stat(sample, "sum").collect()}
    assert tot["revenue"] == 3857000 and tot["customers"] == 449
    assert [c["column"] for c in S.metric_cards(sample).collect()][4:] == ["seats"]
    cards = S.metric_cards(sample, 4).collect()
    assert [c["column"] for c in cards] == ["revenue", "arr", "mrr", "customers"]


def test_chart_categoricals(sample, spark):
    got = [r["column"] for r in P.chart_categoricals(sample).collect()]
    assert sorted(got) == ["month", "region"]
    one = spark.createDataFrame([("a",), ("a",)], "c string")
    assert P.chart_categoricals(one).count() == 0


def test_histogram_box_density(sample):
    h = D.histogram(sample, "revenue", 25).collect()
    assert len(h) == 25 and sum(r["count"] for r in h) == 18
    assert h[-1]["count"] >= 1  # the max lands in the last bin
    b = D.box_summary(sample, "revenue").first()
    assert b["n"] == 18 and b["median"] == 138500.0
    d = D.density_grid(sample, "revenue").collect()
    assert len(d) == 64 and all(r["density"] >= 0 for r in d)


def test_normalised_series(sample, spark):
    got = S.normalised_series(sample, "revenue", "_row_id").orderBy("position").collect()
    assert len(got) == 18 and got[0]["x"] == 0.0 and got[-1]["x"] == 1.0
    assert min(r["y"] for r in got) == 0.0 and max(r["y"] for r in got) == 1.0
    one = spark.createDataFrame([(0, 5.0)], "_row_id long, v double")
    assert S.normalised_series(one, "v", "_row_id").count() == 0


def test_analyse_specs(sample):
    assert S.analyse(sample, {"kind": "filter", "column": "revenue", "op": ">", "value": 400000}).count() == 4
    top = S.analyse(sample, {"kind": "top_rows", "metric": "mrr", "n": 2}).collect()
    assert [r["mrr"] for r in top] == [1600000, 1516667]
    corr = S.analyse(sample, {"kind": "correlation", "a": "arr", "b": "mrr"}).first()[0]
    assert corr > 0.99


def test_insights_and_report(sample, spark):
    rows = {r["kind"]: r["text"] for r in RP.insights(sample, "region").collect()}
    assert rows["top_group"] == "North America is the top region by revenue (2,550,000)."
    assert rows["shape"] == "Dataset has 18 rows × 7 columns with no missing values."
    lines = [r["line"] for r in RP.report_lines("today", None, sample, None).orderBy("line_no").collect()]
    assert lines[0] == "# Executive Report"
    assert "| revenue | 3,857,000.00 | 214,277.78 | 480,000.00 |" in lines


def test_numeric_summary_all_null_column(spark):
    t = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "a double, b double")
    got = {r["column"]: r for r in P.numeric_summary(t).collect()}
    assert got["a"]["median"] == 2.0 and got["a"]["count"] == 3
    assert got["b"]["count"] == 0 and got["b"]["median"] is None and got["b"]["mean"] is None


def test_csv_quotes_codes_and_booleans(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('note,code,flag,part,level\n"two\nlines",1d,True,True,1e3\n"said ""yes"", twice",2f,False,,-inf\nplain,3,true,False, 4\n')
    df = read_metrics(spark, str(p))
    rows = df.orderBy("_row_id").collect()
    assert [r["_row_id"] for r in rows] == [0, 1, 2]
    assert [r["note"] for r in rows] == ["two\nlines", 'said "yes", twice', "plain"]
    assert [r["code"] for r in rows] == ["1d", "2f", "3"]
    assert [r["flag"] for r in rows] == [True, False, True]
    assert [r["part"] for r in rows] == ["True", None, "False"]
    assert [r["level"] for r in rows] == [1000.0, float("-inf"), 4.0]
    assert P.categorical_columns(df) == ["note", "code", "part"] and P.numeric_columns(df) == ["level"]


def test_csv_rows_follow_files(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    (d / "a.csv").write_text("x\n1\n2\n")
    (d / "b.csv").write_text("x\n" + "\n".join(str(i) for i in range(3, 400)) + "\n")
    rows = read_metrics(spark, str(d)).orderBy("_row_id").collect()
    assert [r["x"] for r in rows] == list(range(1, 400))
