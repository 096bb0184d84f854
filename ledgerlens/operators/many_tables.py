"""Claims against many metric tables of any schemas in one job.

A set of tables is one long table of cells, the schema of each table being
data in it: ``table_id``, ``row_id`` (the row's place in its table),
``ordinal`` and ``column`` (the column's place and name), ``numeric``,
``value`` (double, of numeric columns) and ``text`` (the cell as text). A row
without a cell of a column has no value there.

Design for scale:
* the rules of a schema (phrases, names, aliases) are compiled by a projection
  over its array of columns, once per distinct schema, and reach the claims by
  equi-joins on the schema and on ``table_id``; nothing is collected, no query
  grows with the number of schemas, and a claim meets its own table alone;
* a row's cells are gathered once (as many as its table has columns), counted
  for the whole table and for each window its date text names, and aggregated
  per (table, window, column) with partial sums before the shuffle, so one
  table may hold any share of the rows;
* claims of a hot table are split by Spark's skew join, as the other side
  holds one row per table, or per window and column of a table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import claims as CF
from ..functions import text as T
from ..functions import vocab as V
from ..session import cut_lineage
from . import claims as CL
from .profile import column_kind, present

WHOLE = "*"  # the group of all rows of a table


def table_cells(table: DataFrame, table_id: Column | str, order_col: str) -> DataFrame:
    """The cells of a wide metric table, or of many that share its columns:
    ``table_id`` is an expression over its rows, or names the column that says
    whose row it is, which then is no cell."""
    fields = [f for f in table.schema.fields if f.name != order_col and not (isinstance(table_id, str) and f.name == table_id)]
    table_id = F.col(table_id) if isinstance(table_id, str) else table_id
    cells = []
    for i, f in enumerate(fields):
        c, numeric = F.col(f"`{f.name}`"), column_kind(f.dataType) == "numeric"
        value = present(c, f.dataType).cast("double") if numeric else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column"), F.lit(numeric).alias("numeric"),
                              value.alias("value"), c.cast("string").alias("text")))
    return table.select(table_id.cast("string").alias("table_id"), F.col(order_col).alias("row_id"),
                        F.inline(F.array(*cells)))


# ---------------------------------------------------------------- schemas and rules
def _as_words(name: Column) -> Column:
    return F.translate(F.lower(name), "_-", "  ")


def table_schemas(cells: DataFrame) -> DataFrame:
    """(table_id, metrics, date_ordinal): the numeric columns in order, and the
    place of the first column whose name names a date or period."""
    columns = F.array_sort(F.collect_set(F.struct("ordinal", "column", "numeric")))
    per_table = cells.groupBy("table_id").agg(columns.alias("columns"))
    dated = F.filter("columns", lambda c: F.lower(c["column"]).rlike("|".join(V.DATE_NAME_WORDS)))
    return per_table.select("table_id", F.transform(F.filter("columns", lambda c: c["numeric"]),
                                                    lambda c: c["column"]).alias("metrics"),
                            F.get(dated, F.lit(0))["ordinal"].alias("date_ordinal"))


def _rule(kind: str, needles: Column, column: Column, score: int, method: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), needles.alias("needles"), column.alias("column"),
                    F.lit(score).alias("score_pct"), F.lit(method).alias("method"))


def _phrase_rules(metrics: Column, terms: dict, tier: int) -> Column:
    """Rules of the phrases of one tier in their order: a phrase stands for the
    first column that holds its first fitting candidate."""
    rows = []
    for own, _, phrase in CL.phrase_priorities(terms):
        if own == tier:
            kind = "contains" if tier == 0 else "word" if re.fullmatch(r"\w+", phrase) else "pattern"
            needle = r"(?U)\b" + re.escape(phrase) + r"\b" if kind == "pattern" else phrase if tier else CL.plain_name(phrase)
            rows.append(F.struct(F.lit(kind).alias("kind"), F.lit(needle).alias("needle"),
                                 F.array(*[F.lit(CL.plain_name(c)) for c in terms[phrase]]).alias("candidates")))
    if not rows:
        return F.filter(F.transform(metrics, lambda m: _rule("contains", F.array(m), m, 100, "business-term")), lambda r: F.lit(False))
    meant = F.transform(F.array(*rows), lambda p: F.struct(
        p["kind"].alias("kind"), F.array(p["needle"]).alias("needles"),
        F.get(F.flatten(F.transform(p["candidates"], lambda c: F.filter(
            metrics, lambda m: _as_words(m).contains(c)))), F.lit(0)).alias("column"),
        F.lit(100).alias("score_pct"), F.lit("business-term").alias("method")))
    return F.filter(meant, lambda r: r["column"].isNotNull())


def schema_rules(metrics: Column, terms: dict | None = None, aliases: dict | None = None) -> Column:
    """The ordered rules (kind, needles, column, score_pct, method) of an array
    of metric columns; the first that fires wins (C6)."""
    terms = terms if terms is not None else V.BUSINESS_TERMS
    aliases = aliases if aliases is not None else V.DOMAIN_ALIASES
    named = F.transform(metrics, lambda m: _rule("contains", F.array(_as_words(m)), m, 100, "exact"))
    parts = [_phrase_rules(metrics, terms, 0), named, _phrase_rules(metrics, terms, 1)]
    if aliases:
        known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(a) for a in words]).alias("words"))
                          for name, words in aliases.items()])
        spoken = F.transform(metrics, lambda m: _rule("any", F.flatten(F.transform(
            F.filter(known, lambda a: F.lower(m).startswith(a["name"])), lambda a: a["words"])), m, 90, "alias"))
        parts.append(F.filter(spoken, lambda r: F.size(r["needles"]) > 0))
    return F.concat(*parts)


def _hit(claim: Column, rule: Column) -> Column:
    needle = F.get(rule["needles"], F.lit(0))
    return (F.when(rule["kind"] == "word", F.array_contains(claim["words"], needle))
            .when(rule["kind"] == "pattern", F.rlike(claim["norm"], needle))
            .otherwise(F.exists(rule["needles"], lambda n: claim["norm"].contains(n))))


def _fuzzy(claim: Column, metrics: Column) -> Column:
    """The column most alike a run of as many words of the claim. Runs whose
    length alone rules the cut-off out are not compared."""
    tokens = claim["tokens"]

    def alike(m: Column, i: Column) -> Column:
        target = F.trim(F.regexp_replace(_as_words(m), T.WS, " "))
        k = F.size(F.split(target, " "))
        runs = F.when(F.size(tokens) >= k, F.transform(
            F.sequence(F.lit(1), F.size(tokens) - k + 1), lambda s: F.array_join(F.slice(tokens, s, k), " ")))
        near = F.filter(runs, lambda r: F.least(F.length(r), F.length(target)) * 1000
                        >= F.greatest(F.length(r), F.length(target)) * (V.FUZZY_CUTOFF * 10 - 10))
        best = F.array_max(F.transform(near, lambda r: F.lit(1.0) - F.levenshtein(r, target)
                                       / F.greatest(F.length(r), F.length(target))))
        return F.struct(F.coalesce(F.floor(best * 100 + 0.5).cast("int"), F.lit(-1)).alias("s"), (-i).alias("o"), m.alias("c"))

    best = F.array_max(F.transform(metrics, alike))
    return F.when(best["s"] >= V.FUZZY_CUTOFF, F.struct(
        best["c"].alias("column"), best["s"].alias("score_pct"),
        F.concat(F.lit("fuzzy("), best["s"].cast("string"), F.lit(")")).alias("method")))


def match(claim: Column, rules: Column, metrics: Column, fuzzy: bool = True) -> Column:
    """C6 with the rules as data: struct(column, score_pct int, method), or the 'none' struct."""
    norm = _as_words(claim)
    # one element: its parts are computed once for all rules
    bound = F.array(F.struct(norm.alias("norm"), F.split(norm, r"(?U)\W+").alias("words"),
                             F.filter(F.split(norm, T.WS), lambda t: t != F.lit("")).alias("tokens")))

    def one(c: Column) -> Column:
        fired = F.get(F.filter(rules, lambda r: _hit(c, r)), F.lit(0))
        found = F.when(fired.isNotNull(), F.struct(fired["column"].alias("column"), fired["score_pct"].alias("score_pct"),
                                                   fired["method"].alias("method")))
        none = F.struct(F.lit(None).cast("string").alias("column"), F.lit(0).alias("score_pct"), F.lit("none").alias("method"))
        return F.coalesce(found, _fuzzy(c, metrics), none) if fuzzy else F.coalesce(found, none)

    return F.get(F.transform(bound, one), F.lit(0))


def match_claims(claims: DataFrame, cells: DataFrame, terms: dict | None = None, aliases: dict | None = None) -> DataFrame:
    """(table_id, claim_id, claim, metrics, date_ordinal, m): every claim
    (table_id, claim_id, claim) matched to a column of its own table. A claim
    whose table has no cells keeps null ``metrics`` and matches none."""
    tables = table_schemas(cells)
    rules = tables.select("metrics").distinct().withColumn("rules", schema_rules(F.col("metrics"), terms, aliases))
    known = tables.join(rules, "metrics")
    # a claim without a table has no rules: its match is the 'none' struct
    empty = F.array().cast("array<string>")
    joined = claims.select("table_id", "claim_id", "claim").join(known, "table_id", "left")
    return joined.select("table_id", "claim_id", "claim", "metrics", "date_ordinal",
                         match(F.col("claim"), F.col("rules"), F.coalesce("metrics", empty)).alias("m"))


# ---------------------------------------------------------------- statistics and verdicts
def window_stats(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """F5 + F6 + A11: (table_id, token, column, rows, first_val, last_val,
    n_values) for the whole of each table (token '*') and for each window token
    that the date text of its rows contains."""
    rows = cells.groupBy("table_id", "row_id").agg(
        F.collect_list(F.struct("ordinal", "column", "numeric", "value", "text")).alias("cells"))
    rows = rows.join(tables.select("table_id", "date_ordinal"), "table_id")
    date = F.get(F.filter("cells", lambda c: c["ordinal"] == F.col("date_ordinal")), F.lit(0))["text"]
    found = F.array_distinct(F.regexp_extract_all(F.lower(date), F.lit(CL.TOKEN_RE), 1))
    groups = F.concat(F.array(F.lit(WHOLE)), F.coalesce(found, F.array().cast("array<string>")))
    numbers = F.transform(F.filter("cells", lambda c: c["numeric"]),
                          lambda c: F.struct(c["column"].alias("column"), c["value"].alias("value")))
    # one cell more, without a name: its count is the group's number of rows
    row = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(1.0).alias("value")))
    long = (rows.select("table_id", "row_id", F.explode(groups).alias("token"), F.concat(row, numbers).alias("cells"))
            .select("table_id", "row_id", "token", F.inline("cells")))
    present_at = F.when(F.col("value").isNotNull(), F.col("row_id"))
    stats = long.groupBy("table_id", "token", "column").agg(
        F.min_by("value", present_at).alias("first_val"), F.max_by("value", present_at).alias("last_val"),
        F.count("value").alias("n_values"))
    # a window over one group holds a row per column of the table
    count = F.max(F.when(F.col("column").isNull(), F.col("n_values"))).over(Window.partitionBy("table_id", "token"))
    return stats.withColumn("rows", count).filter(F.col("column").isNotNull())


def verify_tables(claims: DataFrame, cells: DataFrame, terms: dict | None = None, aliases: dict | None = None) -> DataFrame:
    """L5 for claims (table_id, claim_id, claim) about many tables: the verdict
    rows of ``claims.verify`` with ``table_id``, all schemas in one job. A claim
    whose table has no numeric column, or no cells, is Unverifiable; a null
    claim matches nothing."""
    parsed = match_claims(claims, cells, terms, aliases).select(
        "*", CF.change(F.col("claim")).alias("chg"), CF.time_window(F.col("claim")).alias("win"))
    token = F.when(F.col("date_ordinal").isNotNull(), CF.window_token(F.col("win")))
    parsed = cut_lineage(parsed.withColumn("token", token), "parsed-claims")
    some = F.size(F.coalesce("metrics", F.array().cast("array<string>"))) > 0
    keys = [F.col("table_id")]

    stats = cut_lineage(window_stats(cells, table_schemas(cells)), "window-stats")
    whole = stats.filter(F.col("token") == WHOLE).select(
        F.col("table_id").alias("_at"), F.col("column").alias("_am"), F.col("rows").alias("total_rows"),
        F.col("first_val").alias("a_first"), F.col("last_val").alias("a_last"), F.col("n_values").alias("a_n"))
    part = stats.filter(F.col("token") != WHOLE).select(
        F.col("table_id").alias("_tt"), F.col("token").alias("_tk"), F.col("column").alias("_tm"),
        F.col("rows").alias("tok_rows"), F.col("first_val").alias("t_first"), F.col("last_val").alias("t_last"),
        F.col("n_values").alias("t_n"))
    j = (parsed.filter(some)
         .join(whole, (F.col("table_id") == F.col("_at")) & (F.col("m.column") == F.col("_am")), "left")
         .join(part, (F.col("table_id") == F.col("_tt")) & (F.col("m.column") == F.col("_tm"))
               & (F.col("token") == F.col("_tk")), "left"))
    return (CL.judge(j, keys, F.get("metrics", F.lit(0)))
            .unionByName(CL.without_metrics(parsed.filter(~some), keys)))
