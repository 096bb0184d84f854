"""Registered queries: claims against many metric tables of three schemas, and
an evaluation run over a labelled set of such tables.

The tables are aggregates of the given ones: a quarterly table per order
priority, a quarterly table per return flag (its ``drift`` starts at zero) and
a table of one row per nation (no date column, too short for a change). Claims
are written from the same aggregates, and fixed sentences are put to every
table. The oracle states the matching rules on its own, as joins of the fixed
phrase and alias lists with the columns.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab as V
from ..operators import many_tables as MT
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.tables import Tables
from .evaluate import evaluate
from .q_claims import _round_verdicts, _sq, sql_change, sql_judge, sql_window
from .q_ops import ROUTE_TEMPLATES, sql_route
from .registry import query

# Fixed sentences put to every table.
ANY_TABLE = [
    "Drift rose by 20%", "Customers grew by 5%", "Clients doubled", "Open orders nearly tripled",
    "Headcount fell by 5%", "Sales more than doubled", "Nothing changed in Q2", "Opening balence rose by 3%",
    "Turnover climbed by 7% in H1", "Openorders fell by 50%", "Orders, units and customers stayed flat",
]


def _cents(col: str) -> Column:
    return F.sum(F.round(F.col(col) * 100).cast("long")) / 100.0


def _period(day: str) -> list[Column]:
    y, q = F.year(day), F.quarter(day)
    return [(y * 10 + q).cast("long").alias("_ord"), F.concat(y.cast("string"), F.lit("-q"), q.cast("string")).alias("period")]


def priority_tables(spark: SparkSession, sf: str) -> DataFrame:
    o = Tables(spark, sf).orders
    return o.groupBy(F.concat(F.lit("priority:"), "o_orderpriority").alias("table_id"), *_period("o_orderdate")).agg(
        _cents("o_totalprice").alias("revenue"), F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))


def flag_tables(spark: SparkSession, sf: str) -> DataFrame:
    li = Tables(spark, sf).lineitem
    t = li.groupBy(F.concat(F.lit("flag:"), "l_returnflag").alias("table_id"), *_period("l_shipdate")).agg(
        _cents("l_extendedprice").alias("gross_sales"), F.sum(F.col("l_quantity").cast("long")).alias("units"))
    first = F.min_by("units", "_ord").over(Window.partitionBy("table_id"))  # a row per quarter
    return t.withColumnRenamed("period", "ship_quarter").withColumn("drift", F.col("units") - first)


def nation_tables(spark: SparkSession, sf: str) -> DataFrame:
    c = Tables(spark, sf).customer
    return c.groupBy(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("table_id")).agg(
        F.count(F.lit(1)).alias("customers"), _cents("c_acctbal").alias("opening_balance")).withColumn(
        "_ord", F.lit(1).cast("long"))


def _table_sets(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [cut_lineage(t(spark, sf), "tables") for t in (priority_tables, flag_tables, nation_tables)]


def _cells(sets: list[DataFrame]) -> DataFrame:
    out = None
    for t in sets:
        cells = MT.table_cells(t, "table_id", "_ord")
        out = cells if out is None else out.unionByName(cells)
    return out


def _yearly_claims(t: DataFrame, a: str, said_a: str, b: str, said_b: str) -> DataFrame:
    """(table_id, claim_id, claim, expected): four claims per table and year
    about the change of ``a`` and ``b`` within the year."""
    yr = F.expr("_ord div 10")
    per = t.groupBy("table_id", yr.alias("yr")).agg(
        F.min_by(a, "_ord").alias("fa"), F.max_by(a, "_ord").alias("la"), F.min_by(b, "_ord").alias("fb"),
        F.max_by(b, "_ord").alias("lb"), F.count(F.lit(1)).alias("nq")).filter("nq >= 2 and fa <> 0 and fb <> 0")
    pa, pb = [(F.col(f"l{x}") - F.col(f"f{x}")) / F.abs(F.col(f"f{x}")) * 100 for x in "ab"]
    up, down = [F.when(pa >= 0, F.lit(x)).otherwise(F.lit(y)) for x, y in (("increased", "declined"), ("declined", "increased"))]
    up_b = F.when(pb >= 0, F.lit("increased")).otherwise(F.lit("declined"))
    size, size_b = F.floor(F.abs(pa)).cast("long"), F.floor(F.abs(pb)).cast("long")
    year = F.col("yr").cast("string")

    def said(k: int, name: str, verb: Column, pct: Column, when: str, expected: str) -> Column:
        return F.struct((F.col("yr") * 100 + k).alias("claim_id"), F.concat(
            F.lit(name + " "), verb, F.lit(" by "), pct.cast("string"), F.lit(when), year).alias("claim"),
            F.lit(expected).alias("expected"))

    return per.select("table_id", F.inline(F.array(
        said(1, said_a, up, size, "% in ", "Supported"), said(2, said_a, down, size, "% in ", "Contradicted"),
        said(3, said_a, up, size + 40, "% in ", "Contradicted"), said(4, said_b, up_b, size_b, "% in FY", "Supported"))))


def _claims(sets: list[DataFrame]) -> DataFrame:
    priority, flag, nation = sets
    tables = priority.select("table_id").unionByName(flag.select("table_id")).unionByName(nation.select("table_id")).distinct()
    fixed = tables.select("table_id", F.inline(F.array(*[
        F.struct(F.lit(i).cast("long").alias("claim_id"), F.lit(s).alias("claim"), F.lit(None).cast("string").alias("expected"))
        for i, s in enumerate(ANY_TABLE, start=1)])))
    return (_yearly_claims(priority, "revenue", "Total revenue", "orders", "Orders")
            .unionByName(_yearly_claims(flag, "gross_sales", "Gross sales", "units", "Unts")).unionByName(fixed))


# ---------------------------------------------------------------- oracle
def _period_sql(day: str) -> str:
    return (f"CAST(year({day}) * 10 + quarter({day}) AS BIGINT) AS _ord, "
            f"CAST(year({day}) AS VARCHAR) || '-q' || CAST(quarter({day}) AS VARCHAR) AS period")


def _cents_sql(col: str) -> str:
    return f"sum(CAST(round({col} * 100) AS BIGINT)) / 100.0"


TABLES_SQL = f"""
  prio AS (SELECT 'priority:' || o_orderpriority AS table_id, {_period_sql('o_orderdate')},
                  CAST({_cents_sql('o_totalprice')} AS DOUBLE) AS revenue, count(*) AS orders,
                  count(*) FILTER (WHERE o_orderstatus = 'O') AS open_orders FROM orders GROUP BY ALL),
  flag0 AS (SELECT 'flag:' || l_returnflag AS table_id, {_period_sql('l_shipdate')},
                   CAST({_cents_sql('l_extendedprice')} AS DOUBLE) AS gross_sales,
                   CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS units FROM lineitem GROUP BY ALL),
  flag AS (SELECT *, units - first_value(units) OVER (PARTITION BY table_id ORDER BY _ord) AS drift FROM flag0),
  nat AS (SELECT 'nation:' || c_nationkey AS table_id, count(*) AS customers,
                 CAST({_cents_sql('c_acctbal')} AS DOUBLE) AS opening_balance FROM customer GROUP BY ALL),
  cells AS (
    SELECT table_id, _ord, 1 AS ordinal, 'revenue' AS col, CAST(revenue AS DOUBLE) AS v, period FROM prio
    UNION ALL SELECT table_id, _ord, 2, 'orders', orders, period FROM prio
    UNION ALL SELECT table_id, _ord, 3, 'open_orders', open_orders, period FROM prio
    UNION ALL SELECT table_id, _ord, 1, 'gross_sales', gross_sales, period FROM flag
    UNION ALL SELECT table_id, _ord, 2, 'units', units, period FROM flag
    UNION ALL SELECT table_id, _ord, 3, 'drift', drift, period FROM flag
    UNION ALL SELECT table_id, 1, 1, 'customers', customers, NULL FROM nat
    UNION ALL SELECT table_id, 1, 2, 'opening_balance', opening_balance, NULL FROM nat)
"""


def _yearly_sql(table: str, a: str, said_a: str, b: str, said_b: str) -> str:
    up, down = [f"CASE WHEN {{p}} >= 0 THEN '{x}' ELSE '{y}' END" for x, y in (("increased", "declined"), ("declined", "increased"))]
    src = f"""(SELECT table_id, yr, (la - fa) / abs(fa) * 100 AS pa, (lb - fb) / abs(fb) * 100 AS pb FROM (
      SELECT table_id, _ord // 10 AS yr, CAST(arg_min({a}, _ord) AS DOUBLE) AS fa, CAST(arg_max({a}, _ord) AS DOUBLE) AS la,
             CAST(arg_min({b}, _ord) AS DOUBLE) AS fb, CAST(arg_max({b}, _ord) AS DOUBLE) AS lb, count(*) AS nq
      FROM {table} GROUP BY ALL) WHERE nq >= 2 AND fa <> 0 AND fb <> 0)"""
    said = [(1, said_a, up, "pa", 0, "in ", "Supported"), (2, said_a, down, "pa", 0, "in ", "Contradicted"),
            (3, said_a, up, "pa", 40, "in ", "Contradicted"), (4, said_b, up, "pb", 0, "in FY", "Supported")]
    return " UNION ALL ".join(
        f"SELECT table_id, yr * 100 + {k} AS claim_id, '{name} ' || {verb.format(p=p)} || ' by ' "
        f"|| (CAST(floor(abs({p})) AS BIGINT) + {more}) || '% {when}' || yr AS claim, '{e}' AS expected FROM {src}"
        for k, name, verb, p, more, when, e in said)


SAID_SQL = f"""
  said AS (
    {_yearly_sql('prio', 'revenue', 'Total revenue', 'orders', 'Orders')}
    UNION ALL {_yearly_sql('flag', 'gross_sales', 'Gross sales', 'units', 'Unts')}
    UNION ALL SELECT table_id, f.col0, f.col1, NULL FROM (SELECT DISTINCT table_id FROM cells) CROSS JOIN
      (VALUES {", ".join(f"({i}, {_sq(s)})" for i, s in enumerate(ANY_TABLE, start=1))}) f)
"""

_TERMS = ", ".join(f"({_sq(p)}, {i}, {j}, {_sq(c)})" for i, (p, cs) in enumerate(V.BUSINESS_TERMS.items()) for j, c in enumerate(cs))
_ALIASES = ", ".join(f"({_sq(n)}, {_sq(w)})" for n, ws in V.DOMAIN_ALIASES.items() for w in ws)

MATCH_SQL = f"""
  plain AS (SELECT table_id, claim_id, claim, expected, translate(lower(claim), '_-', '  ') AS norm FROM said),
  cols AS (SELECT DISTINCT table_id, ordinal, col, translate(lower(col), '_-', '  ') AS name FROM cells),
  terms(phrase, pos, cand_no, cand) AS (VALUES {_TERMS}),
  aliases(base, word) AS (VALUES {_ALIASES}),
  meant AS (SELECT table_id, phrase, pos, arg_min(col, (cand_no, ordinal)) AS col
            FROM cols JOIN terms ON contains(name, translate(lower(cand), '_-', '  ')) GROUP BY ALL),
  rules AS (
    SELECT table_id, 0 AS tier, -length(phrase) AS k1, pos AS k2, translate(lower(phrase), '_-', '  ') AS needle, col,
           100 AS score, 'business-term' AS how FROM meant WHERE contains(phrase, ' ') OR contains(phrase, '&')
    UNION ALL SELECT table_id, 1, ordinal, 0, name, col, 100, 'exact' FROM cols
    UNION ALL SELECT table_id, 2, -length(phrase), pos, phrase, col, 100, 'business-term' FROM meant
              WHERE NOT contains(phrase, ' ') AND NOT contains(phrase, '&')
    UNION ALL SELECT table_id, 3, ordinal, 0, word, col, 90, 'alias' FROM cols JOIN aliases ON starts_with(lower(col), base)),
  fired AS (SELECT p.table_id, claim_id, col, score, how FROM plain p JOIN rules r ON r.table_id = p.table_id
            AND CASE WHEN tier = 2 THEN regexp_matches(norm, '\\b' || needle || '\\b') ELSE contains(norm, needle) END
            QUALIFY row_number() OVER (PARTITION BY p.table_id, claim_id ORDER BY tier, k1, k2) = 1),
  runs AS (SELECT table_id, claim_id, ordinal, col, name, unnest(list_transform(generate_series(1, len(ws) - k + 1),
                  lambda s: array_to_string(ws[s:s + k - 1], ' '))) AS run
           FROM (SELECT p.table_id, claim_id, list_filter(regexp_split_to_array(norm, '\\s+'), lambda t: t <> '') AS ws
                 FROM plain p ANTI JOIN fired f ON f.table_id = p.table_id AND f.claim_id = p.claim_id)
           JOIN (SELECT *, len(string_split(name, ' ')) AS k FROM cols) USING (table_id)),
  near AS (SELECT table_id, claim_id, ordinal, col, CAST(floor(max(1.0 - levenshtein(run, name)
                  / greatest(length(run), length(name))) * 100 + 0.5) AS INTEGER) AS score FROM runs
           GROUP BY table_id, claim_id, ordinal, col
           HAVING score >= 60 QUALIFY row_number() OVER (PARTITION BY table_id, claim_id ORDER BY score DESC, ordinal) = 1),
  matched AS (SELECT p.table_id, p.claim_id, claim, expected, coalesce(f.col, n.col) AS mcol, coalesce(f.score, n.score, 0) AS sp,
                     coalesce(f.how, 'fuzzy(' || n.score || ')', 'none') AS method
              FROM plain p LEFT JOIN fired f ON f.table_id = p.table_id AND f.claim_id = p.claim_id
                   LEFT JOIN near n ON n.table_id = p.table_id AND n.claim_id = p.claim_id)
"""

_CH, _WN = sql_change("claim"), sql_window("claim")
STATS_SQL = f"""
  parsed AS (SELECT *, {_CH['pct']} AS pct, {_CH['direction']} AS dirn, {_CH['tolerance']} AS tol, {_CH['mode']} AS mode,
                    {_WN['type']} AS wtype, {_WN['value']} AS wvalue FROM matched),
  asked AS (SELECT *, CASE wtype WHEN 'quarter' THEN 'q' || wvalue WHEN 'half' THEN 'h' || wvalue
                                 WHEN 'year' THEN CAST(wvalue AS VARCHAR) END AS token FROM parsed),
  tot AS (SELECT table_id, count(DISTINCT _ord) AS total_rows FROM cells GROUP BY ALL),
  al AS (SELECT table_id, col, arg_min(v, _ord) AS a_first, arg_max(v, _ord) AS a_last, count(v) AS a_n FROM cells GROUP BY ALL),
  tm AS (SELECT c.table_id, token, col, count(DISTINCT _ord) AS tok_rows, arg_min(v, _ord) AS t_first,
                arg_max(v, _ord) AS t_last, count(v) AS t_n
         FROM (SELECT DISTINCT table_id, token FROM asked) a JOIN cells c ON c.table_id = a.table_id AND contains(period, token)
         GROUP BY ALL),
  j AS (SELECT asked.*, total_rows, a_first, a_last, a_n, tok_rows, t_first, t_last, t_n,
               arg_min_col AS candidate, coalesce(tok_rows BETWEEN 2 AND total_rows - 1, false) AS tf
        FROM asked JOIN tot ON tot.table_id = asked.table_id
             JOIN (SELECT table_id AS ct, arg_min(col, ordinal) AS arg_min_col FROM cells GROUP BY ALL) ON ct = asked.table_id
             LEFT JOIN al ON al.table_id = asked.table_id AND al.col = mcol
             LEFT JOIN tm ON tm.table_id = asked.table_id AND tm.col = mcol AND tm.token = asked.token),
"""

VERIFY_TABLES_SQL = f"WITH {TABLES_SQL}, {SAID_SQL}, {MATCH_SQL}, {STATS_SQL} {sql_judge('candidate', 'table_id, ')}"


# ---------------------------------------------------------------- queries
@query("match_tables", f"""
WITH {TABLES_SQL}, {SAID_SQL}, {MATCH_SQL}
SELECT table_id, claim_id, mcol AS column, sp AS score_pct, method FROM matched
""")
def q_match_tables(spark, sf):
    sets = _table_sets(spark, sf)
    return MT.match_claims(_claims(sets), _cells(sets)).select("table_id", "claim_id", "m.column", "m.score_pct", "m.method")


@query("verify_tables", VERIFY_TABLES_SQL)
def q_verify_tables(spark, sf):
    sets = _table_sets(spark, sf)
    return _round_verdicts(MT.verify_tables(_claims(sets), _cells(sets)))


def labelled_set(spark: SparkSession, sf: str) -> str:
    """The folder of a labelled set written from the tables, a document a line:
    a claim case for every claim with an expected verdict, with the numbers of
    its year, and a routing case per table and template."""
    priority, flag, _ = _table_sets(spark, sf)
    cases = None
    for t, claims, cols in [
            (priority, _yearly_claims(priority, "revenue", "Total revenue", "orders", "Orders"), ["revenue", "orders", "open_orders"]),
            (flag, _yearly_claims(flag, "gross_sales", "Gross sales", "units", "Unts"), ["gross_sales", "units", "drift"])]:
        per = t.groupBy("table_id", F.expr("_ord div 10").alias("yr")).agg(
            F.array_sort(F.collect_list(F.struct("_ord", *cols))).alias("rows"))  # at most four quarters
        data = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(f"rows.{c}").cast("array<double>"))])
        own = claims.withColumn("yr", F.expr("claim_id div 100")).join(per, ["table_id", "yr"]).select(
            F.concat("table_id", F.lit("#"), F.col("claim_id").cast("string")).alias("id"), "claim",
            data.alias("csv_data"), F.col("expected").alias("expected_verdict"))
        cases = own if cases is None else cases.unionByName(own)
    tables = priority.select("table_id").unionByName(flag.select("table_id")).distinct()
    routes = tables.select(F.inline(F.array(*[
        F.struct(F.concat("table_id", F.lit(f"?{i}")).alias("id"),
                 F.replace(F.lit(text), F.lit("{name}"), F.col("table_id")).alias("question"), F.lit(e).alias("expected_route"))
        for i, text, e in ROUTE_TEMPLATES])))
    path = os.path.join(ensure_checkpoint_dir(spark), f"labelled-set-{uuid.uuid4().hex}")
    lines = cases.select(F.to_json(F.struct(F.array(F.struct("*")).alias("claim_eval"))).alias("value"))
    lines.unionByName(routes.select(F.to_json(F.struct(F.array(F.struct("*")).alias("router_eval"))).alias("value"))).write.text(path)
    return path


RUN_SQL = f"""
WITH {TABLES_SQL}, said AS (
    {_yearly_sql('prio', 'revenue', 'Total revenue', 'orders', 'Orders')}
    UNION ALL {_yearly_sql('flag', 'gross_sales', 'Gross sales', 'units', 'Unts')}),
-- a case's own table holds one year, its period text is no part of it
ends AS (SELECT table_id, _ord // 10 AS yr, col, arg_min(v, _ord) AS fv, arg_max(v, _ord) AS lv, count(v) AS n FROM cells GROUP BY ALL),
named AS (SELECT s.*, CASE WHEN starts_with(claim, 'Total revenue') THEN 'revenue' WHEN starts_with(claim, 'Orders') THEN 'orders'
                           WHEN starts_with(claim, 'Gross sales') THEN 'gross_sales' ELSE 'units' END AS col,
                 {_CH['pct']} AS pct, {_CH['direction']} AS dirn FROM said s),
act AS (SELECT named.*, (lv - fv) / abs(fv) * 100 AS a FROM named JOIN ends USING (table_id, col) WHERE yr = claim_id // 100),
judged AS (SELECT expected, CASE WHEN dirn = CASE WHEN a >= 0 THEN 'increase' ELSE 'decrease' END
                                      AND abs(abs(a) - pct) <= {V.PERCENT_TOLERANCE} THEN 'Supported' ELSE 'Contradicted' END AS verdict FROM act),
asks AS (SELECT expected, {sql_route('question')} AS route FROM (
    SELECT t.col1 AS expected, replace(t.col0, '{{name}}', table_id) AS question FROM (SELECT DISTINCT table_id FROM cells
    WHERE NOT starts_with(table_id, 'nation')) CROSS JOIN (VALUES {", ".join(f"({_sq(t)}, '{e}')" for _, t, e in ROUTE_TEMPLATES)}) t)),
every AS (SELECT 'claims' AS suite, expected, verdict = expected AS ok FROM judged
          UNION ALL SELECT 'router', expected, route = expected FROM asks)
SELECT suite, coalesce(expected, 'all') AS slice, round(count(*) FILTER (WHERE ok) / count(*)::DOUBLE, 6) AS value,
       count(*) FILTER (WHERE ok) AS hits, count(*) AS total FROM every GROUP BY GROUPING SETS ((suite), (suite, expected))
UNION ALL SELECT 'retrieval', 'all', 0.0, 0, 0 UNION ALL SELECT 'citation', 'all', 0.0, 0, 0
"""


@query("evaluation_run", RUN_SQL)
def q_evaluation_run(spark, sf):
    """L9 with S4 and S6: the labelled set is read as files, the report is the
    one read back from the results folder."""
    out = os.path.join(ensure_checkpoint_dir(spark), f"evaluation-{uuid.uuid4().hex}")
    evaluate(spark, labelled_set(spark, sf), out, multi_line=False)
    report = spark.read.schema("suite string, slice string, value double, hits long, total long").json(out + "/metrics")
    return report.select("suite", "slice", F.round("value", 6).alias("value"), "hits", "total")
