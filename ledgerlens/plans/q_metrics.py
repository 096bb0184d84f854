"""Registered queries: profiling, statistics and distributions over the
given tables. Doubles are rounded on both sides (summation order differs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distribution as D
from ..operators import profile as P
from ..operators import stats as S
from ..sources.tables import Tables
from .registry import query

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_ALL = LINEITEM_NUMERIC + ["l_returnflag", "l_linestatus", "l_shipdate"]


def rnd(df: DataFrame, digits: int = 4, cols: list[str] | None = None) -> DataFrame:
    """Round the double columns (or ``cols``) of a result for comparison."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.name in names
                       else F.col(f.name) for f in df.schema.fields])


def customer_activity(spark: SparkSession, sf: str, orders: str = "true") -> DataFrame:
    """Customers with the totals of their orders, or of those that ``orders``
    (a condition) fits; customers without any carry nulls.
    Ordered by c_custkey (the row order column)."""
    t = Tables(spark, sf)
    per_cust = t.orders.filter(orders).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("o_totalprice").alias("order_total"),
        F.max("o_orderpriority").alias("top_priority"))
    return (t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
            .join(per_cust, F.col("c_custkey") == F.col("o_custkey"), "left")
            .drop("o_custkey"))


CUSTOMER_ACTIVITY_SQL = """
  (SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, o.n_orders, o.order_total, o.top_priority
   FROM customer c LEFT JOIN (
     SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS order_total,
            max(o_orderpriority) AS top_priority
     FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)
"""


URGENT = "o_orderpriority = '1-URGENT'"
URGENT_ACTIVITY_SQL = CUSTOMER_ACTIVITY_SQL.replace("FROM orders GROUP", f"FROM orders WHERE {URGENT} GROUP")


def _union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- flagship A5
def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    cust = t.customer.select("c_custkey", "c_nationkey") \
        .join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = t.orders.select("o_custkey", "o_totalprice") \
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return rnd(S.grouped_top(joined, "n_name", "o_totalprice", "sum", 10, "total_price"), 2)


query("grouped_sum_top", """
SELECT n_name, round(sum(o_totalprice), 2) AS total_price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE n_name IS NOT NULL
GROUP BY n_name ORDER BY sum(o_totalprice) DESC, n_name LIMIT 10
""")(revenue_by_nation)


# ---------------------------------------------------------------- profiling P1-P8
_LI_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
             "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
             "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
             "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}
_KIND = {"bigint": "numeric", "int": "numeric", "double": "numeric", "string": "categorical",
         "timestamp_ntz": "other"}


@query("table_profile", _union_sql([
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, '{_LI_TYPES[c]}' AS dtype, "
    f"'{_KIND[_LI_TYPES[c]]}' AS kind, count(*) AS rows, count({c}) AS non_null, "
    f"count(*) - count({c}) AS missing FROM lineitem"
    for i, c in enumerate(LINEITEM_ALL)]))
def q_table_profile(spark, sf):
    return P.profile(Tables(spark, sf).lineitem)


@query("column_kinds", _union_sql([
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, '{_LI_TYPES[c]}' AS dtype, "
    f"'{_KIND[_LI_TYPES[c]]}' AS kind, count({c}) AS non_null FROM lineitem"
    for i, c in enumerate(LINEITEM_ALL)]))
def q_column_kinds(spark, sf):
    return P.column_listing(Tables(spark, sf).lineitem)


@query("numeric_columns", _union_sql([
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, '{_LI_TYPES[c]}' AS dtype, "
    f"'numeric' AS kind, count({c}) AS non_null FROM lineitem"
    for i, c in enumerate(LINEITEM_ALL) if _KIND[_LI_TYPES[c]] == "numeric"]))
def q_numeric_columns(spark, sf):
    return P.column_listing(Tables(spark, sf).lineitem, "numeric")


_ACT = ["c_custkey", "c_mktsegment", "c_acctbal", "n_orders", "order_total", "top_priority"]


@query("dataset_summary", f"""
SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns,
  'c_custkey, c_acctbal, n_orders, order_total' AS numeric_columns,
  'c_mktsegment, top_priority' AS categorical_columns
FROM {CUSTOMER_ACTIVITY_SQL} t
""")
def q_dataset_summary(spark, sf):
    return P.dataset_summary(customer_activity(spark, sf))


@query("missing_report", "SELECT * FROM (" + _union_sql([
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(*) - count({c}) AS missing "
    f"FROM {URGENT_ACTIVITY_SQL} t"
    for i, c in enumerate(_ACT)]) + ") WHERE missing > 0")
def q_missing_report(spark, sf):
    """Over the customers' urgent orders, which many customers do not have."""
    return P.missing_report(customer_activity(spark, sf, URGENT))


@query("missing_total", "SELECT CAST(" + " + ".join(
    f"(count(*) - count({c}))" for c in _ACT) + f" AS BIGINT) AS missing_total FROM {URGENT_ACTIVITY_SQL} t")
def q_missing_total(spark, sf):
    return P.missing_total(customer_activity(spark, sf, URGENT))


_CUST = [("c_custkey", "c_custkey"), ("c_name", "c_name"), ("c_nationkey", "c_nationkey"),
         ("c_acctbal", "c_acctbal"), ("c_mktsegment", "c_mktsegment")]


@query("column_samples", _union_sql([
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, "
    f"list(CAST({c} AS VARCHAR) ORDER BY c_custkey) [1:3] AS samples "
    f"FROM (SELECT * FROM customer WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 3)"
    for i, (c, _) in enumerate(_CUST)]))
def q_column_samples(spark, sf):
    return P.column_samples(Tables(spark, sf).customer, "c_custkey", 3)


@query("numeric_summary", _union_sql([
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count({c}) AS count, round(avg({c}), 4) AS mean, "
    f"round(CAST(median({c}) AS DOUBLE), 4) AS median, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
    f"round(CAST(max({c}) AS DOUBLE), 4) AS max, round(stddev_samp({c}), 4) AS std FROM lineitem"
    for i, c in enumerate(LINEITEM_NUMERIC)]))
def q_numeric_summary(spark, sf):
    return rnd(P.numeric_summary(Tables(spark, sf).lineitem, limit=8), 4)


_PART_CAT = [("p_name", 1), ("p_brand", 2), ("p_type", 3)]


@query("chart_categoricals", "SELECT * FROM (" + _union_sql([
    f"SELECT '{c}' AS \"column\", {o} AS ordinal, count(DISTINCT {c}) AS n_unique FROM part"
    for c, o in _PART_CAT]) + ") WHERE n_unique > 1 AND n_unique <= 50")
def q_chart_categoricals(spark, sf):
    return P.chart_categoricals(Tables(spark, sf).part, 50)


# ---------------------------------------------------------------- statistics A1-A10
def _stat_sql(fn: str, wrap: str = "{}") -> str:
    return _union_sql([
        f"SELECT '{c}' AS \"column\", {i} AS ordinal, "
        f"round(CAST({wrap.format(f'{fn}({c})')} AS DOUBLE), 4) + 0.0 AS value FROM lineitem"
        for i, c in enumerate(LINEITEM_NUMERIC)])


@query("metric_totals", _stat_sql("sum", "coalesce({}, 0)"))
def q_metric_totals(spark, sf):
    return rnd(S.column_stat(Tables(spark, sf).lineitem, "sum"), 4)


@query("metric_means", _stat_sql("avg"))
def q_metric_means(spark, sf):
    return rnd(S.column_stat(Tables(spark, sf).lineitem, "avg"), 4)


@query("metric_max", _stat_sql("max"))
def q_metric_max(spark, sf):
    return rnd(S.column_stat(Tables(spark, sf).lineitem, "max"), 4)


@query("metric_min", _stat_sql("min"))
def q_metric_min(spark, sf):
    return rnd(S.column_stat(Tables(spark, sf).lineitem, "min"), 4)


@query("grouped_mean", """
SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_price
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
""")
def q_grouped_mean(spark, sf):
    return rnd(S.grouped(Tables(spark, sf).orders, "o_orderpriority", "o_totalprice", "avg",
                         "avg_price"), 4)


@query("top_group", """
SELECT p_brand, round(sum(l_extendedprice), 2) AS revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY sum(l_extendedprice) DESC, p_brand LIMIT 1
""")
def q_top_group(spark, sf):
    t = Tables(spark, sf)
    j = t.lineitem.select("l_partkey", "l_extendedprice") \
        .join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rnd(S.grouped_top(j, "p_brand", "l_extendedprice", "sum", 1, "revenue"), 2)


_ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("metric_cards", _union_sql([
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, round(CAST(coalesce(sum({c}), 0) AS DOUBLE), 2) AS total, "
    f"count({c}) AS non_null FROM orders" for i, c in enumerate(_ORD_NUM)]))
def q_metric_cards(spark, sf):
    return rnd(S.metric_cards(Tables(spark, sf).orders, 4), 2)


@query("key_metrics", _union_sql([
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, round(CAST(coalesce(sum({c}), 0) AS DOUBLE), 4) AS total, "
    f"round(avg({c}), 4) AS mean, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM lineitem"
    for i, c in enumerate(LINEITEM_NUMERIC)]))
def q_key_metrics(spark, sf):
    return rnd(S.key_metrics(Tables(spark, sf).lineitem, 8), 4)


@query("metric_corr", """
SELECT round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem
""")
def q_metric_corr(spark, sf):
    return rnd(S.correlation(Tables(spark, sf).lineitem, "l_quantity", "l_extendedprice"), 6)


@query("row_filter", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 300000
""")
def q_row_filter(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return S.analyse(o, {"kind": "filter", "column": "o_totalprice", "op": ">", "value": 300000.0})


@query("top_rows", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10
""")
def q_top_rows(spark, sf):
    li = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return S.analyse(li, {"kind": "top_rows", "metric": "l_extendedprice", "n": 10,
                          "tie_cols": ["l_orderkey", "l_linenumber"]})


@query("share_of_total", """
WITH g AS (
  SELECT r_name, sum(o_totalprice) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name ORDER BY revenue DESC, r_name LIMIT 8)
SELECT r_name, round(revenue, 2) AS revenue, round(revenue / sum(revenue) OVER (), 6) AS share FROM g
""")
def q_share_of_total(spark, sf):
    t = Tables(spark, sf)
    geo = t.nation.select("n_nationkey", "n_regionkey") \
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    cust = t.customer.select("c_custkey", "c_nationkey") \
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    j = t.orders.select("o_custkey", "o_totalprice").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    top = S.grouped_top(j, "r_name", "o_totalprice", "sum", 8, "revenue")
    out = S.share_of_total(top, "revenue")
    return out.select("r_name", F.round("revenue", 2).alias("revenue"), F.round("share", 6).alias("share"))


# ---------------------------------------------------------------- distributions
@query("histogram25", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (
  SELECT least(CAST(floor(CASE WHEN hi - lo = 0 THEN 0.0
                               ELSE (l_extendedprice - lo) / (hi - lo) * 25 END) AS BIGINT) + 1, 25) AS bin,
         count(*) AS cnt
  FROM lineitem, b GROUP BY 1)
SELECT g.bin, round(lo + (g.bin - 1) * (hi - lo) / 25, 4) AS lo, round(lo + g.bin * (hi - lo) / 25, 4) AS hi,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM (SELECT range AS bin FROM range(1, 26)) g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin
""")
def q_histogram(spark, sf):
    return rnd(D.histogram(Tables(spark, sf).lineitem, "l_extendedprice", 25), 4)


@query("box_summary", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS med,
                  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT count(*) AS n, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3,
  round(min(o_totalprice) FILTER (WHERE o_totalprice BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)), 4) AS whisker_low,
  round(max(o_totalprice) FILTER (WHERE o_totalprice BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1)), 4) AS whisker_high,
  count(*) FILTER (WHERE NOT (o_totalprice BETWEEN q1 - 1.5*(q3-q1) AND q3 + 1.5*(q3-q1))) AS outliers
FROM orders, q GROUP BY q1, med, q3
""")
def q_box(spark, sf):
    return rnd(D.box_summary(Tables(spark, sf).orders, "o_totalprice"), 4)


@query("density_grid", """
WITH s AS (SELECT stddev_samp(o_totalprice) AS sd, count(*) AS n, min(o_totalprice) AS lo,
                  max(o_totalprice) AS hi FROM orders),
h AS (SELECT 1.06 * sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, n, lo, hi FROM s),
c AS (SELECT least(CAST(floor(CASE WHEN hi - lo = 0 THEN 0.0
                              ELSE (o_totalprice - lo) / (hi - lo) * 25 END) AS BIGINT) + 1, 25) AS bin,
             count(*) AS cnt FROM orders, h GROUP BY 1),
bins AS (SELECT ((lo + (bin - 1) * (hi - lo) / 25) + (lo + bin * (hi - lo) / 25)) / 2 AS center, cnt FROM c, h),
g AS (SELECT range AS point FROM range(0, 64))
SELECT point, round(lo + point * (hi - lo) / 63, 4) AS x,
  round(sum(cnt * exp(-0.5 * ((lo + point * (hi - lo) / 63 - center) / bw)
                         * ((lo + point * (hi - lo) / 63 - center) / bw))) / (n * bw * sqrt(2 * pi())), 12) AS density
FROM g, bins, h GROUP BY point, lo, hi, n, bw
""")
def q_density(spark, sf):
    out = D.density_grid(Tables(spark, sf).orders, "o_totalprice", 64, 25)
    return out.select("point", F.round("x", 4).alias("x"), F.round("density", 12).alias("density"))


@query("normalised_series", """
WITH v AS (SELECT event_id, value FROM events WHERE value IS NOT NULL),
s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM v)
SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, round(value, 4) AS value,
  round((row_number() OVER (ORDER BY event_id) - 1) / (n - 1), 6) AS x,
  round((value - lo) / CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END, 6) AS y
FROM v, s WHERE n >= 2
""")
def q_series(spark, sf):
    out = S.normalised_series(Tables(spark, sf).events, "value", "event_id")
    return out.select("position", F.round("value", 4).alias("value"), F.round("x", 6).alias("x"),
                      F.round("y", 6).alias("y"))


@query("series_points", """
WITH v AS (SELECT event_id, value FROM events WHERE value IS NOT NULL),
s AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM v),
p AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS position, value FROM v),
r AS (SELECT position, value, position / (n - 1) AS x, (value - lo) / CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END AS y,
             CASE WHEN n <= 400 THEN position ELSE floor(position * 100 / n) END AS part FROM p, s WHERE n >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY position) AS a, row_number() OVER (PARTITION BY part ORDER BY position DESC) AS b,
             row_number() OVER (PARTITION BY part ORDER BY value, position) AS c, row_number() OVER (PARTITION BY part ORDER BY value DESC, position) AS d FROM r)
SELECT position, round(value, 4) AS value, round(x, 6) AS x, round(y, 6) AS y FROM k WHERE 1 IN (a, b, c, d)
""")
def q_series_points(spark, sf):
    series = S.normalised_series(Tables(spark, sf).events, "value", "event_id")
    out = S.series_points(series, 400)
    return out.select("position", F.round("value", 4).alias("value"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
