"""Question routing (C11, J8), table-question intents (C12, F11), answers
over a table (L1) and cleaning of stored model routing responses (C14, N2).

Keyword lists compile to one alternation per route (word boundaries for
single words, substring for phrases), so routing is a projection. Answers
join each question to statistics computed in one pass over the table and
shipped as a single scalar map (no cross join, no per-question scan).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from .profile import categorical_columns, numeric_columns, visible_fields


def keyword_regex(words: list[str]) -> str:
    parts = []
    for w in words:
        lit = re.escape(w).replace("\\ ", " ")
        parts.append(lit if " " in w else r"\b" + lit + r"\b")
    return "(?U)" + "|".join(parts)


BOTH_RE = keyword_regex(V.BOTH_KEYWORDS)
CSV_RE = keyword_regex(V.CSV_KEYWORDS)
PDF_RE = keyword_regex(V.PDF_KEYWORDS)


def route(question: Column) -> Column:
    """C11: 'both' beats 'csv' beats 'pdf'; no keyword -> 'pdf'."""
    q = F.lower(question)
    return (F.when(q.rlike(BOTH_RE), F.lit("both"))
            .when(q.rlike(CSV_RE), F.lit("csv"))
            .when(q.rlike(PDF_RE), F.lit("pdf"))
            .otherwise(F.lit("pdf")))


def route_questions(questions: DataFrame, text_col: str = "question") -> DataFrame:
    return questions.withColumn("route", route(F.col(text_col)))


# ---------------------------------------------------------------- intents
def find_column(question_lower: Column, columns: list[str]) -> Column:
    """first column whose lower name occurs in the question; then the same
    with '_' and '-' read as spaces on both sides; else null."""
    out = None
    cleaned = F.translate(question_lower, "_-", "  ")
    for c in columns:
        cond = question_lower.contains(c.lower())
        out = F.when(cond, F.lit(c)) if out is None else out.when(cond, F.lit(c))
    for c in columns:
        cond = cleaned.contains(c.lower().replace("_", " ").replace("-", " "))
        out = F.when(cond, F.lit(c)) if out is None else out.when(cond, F.lit(c))
    return out if out is not None else F.lit(None).cast("string")


def intents(questions: DataFrame, table: DataFrame, text_col: str = "question") -> DataFrame:
    """(question_id, question, intent, metric, group_key) following the
    ordered substring dispatch; numeric intents fall through when the table
    has no numeric column, 'grouped' needs both a category and a metric."""
    nums, cats = numeric_columns(table), categorical_columns(table)
    q = F.lower(F.col(text_col))
    has = {name: None for name, _ in V.INTENT_WORDS}
    for name, words in V.INTENT_WORDS:
        cond = None
        for w in words:
            c = q.contains(w)
            cond = c if cond is None else (cond | c)
        has[name] = cond
    metric = find_column(q, nums)
    gkey = find_column(q, cats)
    numeric_ok = F.lit(bool(nums))
    grouped_ok = F.lit(bool(nums and cats)) & metric.isNotNull() & gkey.isNotNull()
    intent = (F.when(has["summary"], F.lit("summary"))
              .when(has["missing"], F.lit("missing"))
              .when(has["columns"], F.lit("columns"))
              .when(has["numeric"], F.lit("numeric"))
              .when(has["categorical"], F.lit("categorical"))
              .when(has["total"] & numeric_ok, F.lit("total"))
              .when(has["average"] & numeric_ok, F.lit("average"))
              .when(has["max"] & numeric_ok, F.lit("max"))
              .when(has["min"] & numeric_ok, F.lit("min"))
              .when(has["grouped"] & grouped_ok, F.lit("grouped"))
              .otherwise(F.lit("help")))
    out = questions.withColumn("intent", intent)
    return out.select(*questions.columns, "intent",
                      F.when(F.col("intent").isin("total", "average", "max", "min", "grouped"), metric)
                      .alias("metric"),
                      F.when(F.col("intent") == "grouped", gkey).alias("group_key"))


# Fixed value: the help answer.
HELP_TEXT = """
I can answer basic CSV questions right now, such as:
- Give me a summary of the dataset
- What are the numeric columns?
- Which columns have missing values?
- What is the total of a numeric column?
- What is the average of a numeric column?
- Show a numeric column by a category column
"""


def _table_stats(table: DataFrame):
    """One pass: rows, nulls per column, sum/avg/max/min per numeric column,
    returned as a one-row DataFrame of a map metric -> struct and texts."""
    fields = visible_fields(table)
    nums = numeric_columns(table)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [(F.count(F.lit(1)) - F.count(F.col(f"`{f.name}`"))).alias(f"_m{i}") for i, f in enumerate(fields)]
    for i, c in enumerate(nums):
        x = F.col(f"`{c}`")
        aggs += [F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(f"_s{i}"), F.avg(x).alias(f"_a{i}"),
                 F.max(x).cast("double").alias(f"_x{i}"), F.min(x).cast("double").alias(f"_n{i}")]
    one = table.agg(*aggs)
    return one, fields, nums


def _list_text(header: str, items: list[Column]) -> Column:
    return F.concat(F.lit(header), *[F.concat(F.lit("- "), it, F.lit("\n")) for it in items])


def answer_questions(questions: DataFrame, table: DataFrame, text_col: str = "question",
                     top_n: int = V.GROUPED_TOP_N) -> DataFrame:
    """L1: (question_id, intent, metric, group_key, value, answer, groups)."""
    spark = table.sparkSession
    it = intents(questions, table, text_col)
    one, fields, nums = _table_stats(table)
    cats = categorical_columns(table)
    m = {c: i for i, c in enumerate(nums)}

    def per_metric(prefix):
        return F.create_map(*[x for c, i in m.items() for x in (F.lit(c), F.col(f"{prefix}{i}"))]) \
            if nums else F.create_map().cast("map<string,double>")

    def fmt_all(prefix, head):
        return _list_text(head, [F.concat(F.lit(f"{c}: "), F.format_number(F.col(f"{prefix}{i}"), 2))
                                 for c, i in m.items()])

    miss_items = sorted(range(len(fields)), key=lambda i: i)
    missing_sorted = F.array_sort(F.filter(F.array(*[
        F.struct((-F.col(f"_m{i}")).alias("k"), F.lit(i).alias("o"), F.lit(fields[i].name).alias("c"),
                 F.col(f"_m{i}").alias("n")) for i in miss_items]), lambda s: s["n"] > 0))
    missing_text = F.when(F.size(missing_sorted) == 0, F.lit("No missing values were found in the dataset.")) \
        .otherwise(F.concat(F.lit("Missing Values:\n"), F.array_join(F.transform(
            missing_sorted, lambda s: F.concat(F.lit("- "), s["c"], F.lit(": "), s["n"].cast("string"), F.lit("\n"))),
            "")))
    summary_text = F.concat(
        F.lit("\nDataset Summary:\n- Rows: "), F.col("_rows").cast("string"),
        F.lit(f"\n- Columns: {len(fields)}\n- Numeric columns: {', '.join(nums) if nums else 'None'}"
              f"\n- Categorical columns: {', '.join(cats) if cats else 'None'}\n"))
    texts = one.select(F.struct(
        summary_text.alias("summary"), missing_text.alias("missing"),
        (fmt_all("_s", "Totals for numeric columns:\n") if nums else F.lit("")).alias("total_all"),
        (fmt_all("_a", "Averages for numeric columns:\n") if nums else F.lit("")).alias("average_all"),
        (fmt_all("_x", "Maximum values for numeric columns:\n") if nums else F.lit("")).alias("max_all"),
        (fmt_all("_n", "Minimum values for numeric columns:\n") if nums else F.lit("")).alias("min_all"),
        per_metric("_s").alias("sum"), per_metric("_a").alias("avg"),
        per_metric("_x").alias("max"), per_metric("_n").alias("min"))).scalar()

    columns_text = _list_text("Columns in the dataset:\n", [F.lit(f.name) for f in fields])
    numeric_text = (_list_text("Numeric columns:\n", [F.lit(c) for c in nums]) if nums
                    else F.lit("No numeric columns were found in the dataset."))
    cat_text = (_list_text("Categorical columns:\n", [F.lit(c) for c in cats]) if cats
                else F.lit("No categorical columns were found in the dataset."))
    metric = F.col("metric")
    value = (F.when(F.col("intent") == "total", F.element_at(texts["sum"], metric))
             .when(F.col("intent") == "average", F.element_at(texts["avg"], metric))
             .when(F.col("intent") == "max", F.element_at(texts["max"], metric))
             .when(F.col("intent") == "min", F.element_at(texts["min"], metric)))
    phrase = {"total": "The total `{}` is ", "average": "The average `{}` is ",
              "max": "The highest value in `{}` is ", "min": "The lowest value in `{}` is "}
    scalar_text = None
    for k, p in phrase.items():
        head, tail = p.split("{}")
        t = F.concat(F.lit(head), metric, F.lit(tail), F.format_number(value, 2), F.lit("."))
        scalar_text = F.when(F.col("intent") == k, t) if scalar_text is None else scalar_text.when(
            F.col("intent") == k, t)
    all_text = (F.when(F.col("intent") == "total", texts["total_all"])
                .when(F.col("intent") == "average", texts["average_all"])
                .when(F.col("intent") == "max", texts["max_all"])
                .otherwise(texts["min_all"]))
    answer = (F.when(F.col("intent") == "summary", texts["summary"])
              .when(F.col("intent") == "missing", texts["missing"])
              .when(F.col("intent") == "columns", columns_text)
              .when(F.col("intent") == "numeric", numeric_text)
              .when(F.col("intent") == "categorical", cat_text)
              .when(F.col("intent").isin("total", "average", "max", "min") & metric.isNotNull(), scalar_text)
              .when(F.col("intent").isin("total", "average", "max", "min"), all_text)
              .when(F.col("intent") == "grouped",
                    F.concat(F.lit("Here is `"), metric, F.lit("` grouped by `"), F.col("group_key"), F.lit("`.")))
              .otherwise(F.lit(HELP_TEXT)))
    base = it.select("question_id", "intent", "metric", "group_key", value.alias("value"), answer.alias("answer"))

    # grouped intents: every (key, metric) pair asked is answered by ONE
    # aggregation with grouping sets (one set per key); the pair list is
    # bounded by (#categorical x #numeric) columns
    pairs = sorted((r["group_key"], r["metric"]) for r in
                   it.filter(F.col("intent") == "grouped").select("group_key", "metric").distinct().collect())
    if not pairs:
        return base.withColumn("groups", F.lit(None).cast("array<struct<key:string,value:double>>"))
    keys = sorted({k for k, _ in pairs})
    mets = sorted({m for _, m in pairs})
    agg = table.groupingSets([[F.col(f"`{k}`")] for k in keys], *[F.col(f"`{k}`") for k in keys]).agg(
        F.grouping_id().alias("_gid"),
        *[F.coalesce(F.sum(F.col(f"`{m}`")), F.lit(0)).cast("double").alias(f"_s{j}") for j, m in enumerate(mets)])
    n = len(keys)
    entries = []
    for p, (k, m) in enumerate(pairs):
        gid = (1 << n) - 1 - (1 << (n - 1 - keys.index(k)))
        kc = F.col(f"`{k}`")
        entries.append(F.when((F.col("_gid") == gid) & kc.isNotNull(), F.struct(
            F.lit(p).alias("pair"), kc.cast("string").alias("key"), F.col(f"_s{mets.index(m)}").alias("value"))))
    flat = agg.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    w = Window.partitionBy("pair").orderBy(F.desc("value"), F.asc("key"))
    top = flat.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_n)
    pair_dim = spark.createDataFrame([(p, k, m) for p, (k, m) in enumerate(pairs)], "pair int, _k string, _mt string")
    g = (top.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("_r", "key", "value"))).alias("_g"))
         .join(pair_dim, "pair")
         .select("_k", "_mt", F.transform("_g", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
                 .alias("groups")))
    return base.join(F.broadcast(g), (F.col("group_key") == F.col("_k")) & (F.col("metric") == F.col("_mt")),
                     "left").drop("_k", "_mt")


# ---------------------------------------------------------------- responses
def strip_fences(raw: Column) -> Column:
    """C14: drop a leading ```/```json fence and a trailing ``` on any line."""
    s = F.regexp_replace(F.regexp_replace(raw, "(?U)^\\s+|\\s+$", ""), "(?m)^```(?:json)?\\s*", "")
    return F.regexp_replace(s, "(?m)\\s*```$", "")


def clean_route_responses(responses: DataFrame, question_col: str = "question",
                          raw_col: str = "raw") -> DataFrame:
    """Stored model routing replies -> (intent, confidence, reasoning).

    Valid JSON object: intent lower-cased and kept if pdf/csv/both, else (null
    too) the keyword route; confidence default 0.8 clamped to [0,1]; reasoning
    default ''. Anything unparseable, also a confidence of null: keyword route,
    0.5, fallback reasoning.
    """
    v = F.try_parse_json(strip_fences(F.col(raw_col)))
    is_obj = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    given = {k: F.try_variant_get(v, f"$.{k}", "variant") for k in ("intent", "confidence")}
    intent_raw = F.lower(F.coalesce(F.try_variant_get(v, "$.intent", "string"),
                                    F.when(given["intent"].isNull(), F.lit("pdf")).otherwise(F.lit("none"))))
    conf_present = given["confidence"].isNotNull()
    conf_num = F.try_variant_get(v, "$.confidence", "double")
    parse_ok = is_obj & (~conf_present | conf_num.isNotNull())
    kw = route(F.col(question_col))
    intent = F.when(~parse_ok, kw).when(intent_raw.isin(*V.ROUTE_INTENTS), intent_raw).otherwise(kw)
    conf = F.when(~parse_ok, F.lit(V.FALLBACK_ROUTE_CONFIDENCE)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(conf_num, F.lit(V.DEFAULT_ROUTE_CONFIDENCE)))))
    reasoning = F.when(~parse_ok, F.lit("Keyword fallback (LLM parse error).")).otherwise(
        F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("")))
    return responses.select("*", intent.alias("intent"), conf.alias("confidence"), reasoning.alias("reasoning"))
