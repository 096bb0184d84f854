"""Registered queries: routing, table questions, response cleaning,
evaluation metrics, insights, report lines, previews and the CSV source.

Question sets are derived from the tables: every customer yields four
labelled routing questions (one template per route plus one the keyword
router gets wrong), conversation user turns are routed as they are, and
table questions are generated from the lineitem schema and answered over
the whole lineitem table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import chunking as C
from ..operators import claims as CL
from ..operators import evaluation as E
from ..operators import fusion, lexical, profile, report, routing
from ..operators.ordering import with_row_index
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.metrics_csv import read_metrics
from ..sources.sinks import read_report, write_report
from ..sources.tables import Tables
from .q_claims import CLAIMS_SQL, VERIFY_SQL, _sq, derived_claims, verified
from .q_metrics import CUSTOMER_ACTIVITY_SQL, customer_activity
from .q_text import (CHUNKS_SQL, PAGES_SQL, TOKENS_SQL, bm25_sql, chunk_index, doc_pages, hybrid_corpus,
                     hybrid_index, hybrid_questions, hybrid_sql)
from .registry import query

# Fixed templates: (template id, text with {name}, expected route).
ROUTE_TEMPLATES = [
    (1, "What is the average account balance for {name}?", "csv"),
    (2, "What does the report say about {name}?", "pdf"),
    (3, "Verify the claim about {name} against the data.", "both"),
    (4, "Which page mentions the data of {name}?", "pdf"),
]


def labelled_questions(spark: SparkSession, sf: str) -> DataFrame:
    cust = Tables(spark, sf).customer.select("c_custkey", "c_name")
    parts = [cust.select((F.col("c_custkey") * 10 + t).alias("question_id"),
                         F.replace(F.lit(text), F.lit("{name}"), F.col("c_name")).alias("question"),
                         F.lit(exp).alias("expected_route"))
             for t, text, exp in ROUTE_TEMPLATES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LABELLED_SQL = " UNION ALL ".join(
    f"SELECT c_custkey * 10 + {t} AS question_id, replace({_sq(text)}, '{{name}}', c_name) AS question, "
    f"'{exp}' AS expected_route FROM customer" for t, text, exp in ROUTE_TEMPLATES)


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    cv = Tables(spark, sf).conversations
    return cv.filter(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))


USER_TURNS_SQL = "SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user'"


def sql_route(q: str) -> str:
    low = f"lower({q})"
    return (f"CASE WHEN regexp_matches({low}, {_sq(routing.BOTH_RE.replace('(?U)', ''))}) THEN 'both' "
            f"WHEN regexp_matches({low}, {_sq(routing.CSV_RE.replace('(?U)', ''))}) THEN 'csv' ELSE 'pdf' END")


# ---------------------------------------------------------------- routing
@query("route_questions", f"""
SELECT 'labelled' AS source, question_id, {sql_route('question')} AS route FROM ({LABELLED_SQL})
UNION ALL
SELECT 'conversation' AS source, question_id, {sql_route('question')} AS route FROM ({USER_TURNS_SQL})
""")
def q_route_questions(spark, sf):
    lab = labelled_questions(spark, sf).select(F.lit("labelled").alias("source"), "question_id", "question")
    conv = user_turns(spark, sf).select(F.lit("conversation").alias("source"), "question_id", "question")
    return routing.route_questions(lab.unionByName(conv)).select("source", "question_id", "route")


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
LI_CAT = ["l_returnflag", "l_linestatus"]
LI_ALL = LI_NUM + LI_CAT + ["l_shipdate"]


def table_questions() -> list[tuple[int, str]]:
    """Questions generated from the lineitem schema (metadata, not data)."""
    qs = ["Give me a summary of the dataset", "Which columns have missing values?",
          "What are the numeric columns?", "Show average ARR by category", "List the columns please",
          "What is the total revenue?", "What is the lowest value overall?",
          "xyz completely unrecognised question"]
    for c in LI_NUM:
        qs += [f"What is the total {c}?", f"What is the average {c}?", f"What is the highest {c}?",
               f"What is the lowest {c}?"]
    qs += ["Show l_extendedprice by l_returnflag", "Show l quantity by l linestatus",
           "Show the l_discount by l_linestatus"]
    return list(enumerate(qs, start=1))


def _questions_df(spark):
    return spark.createDataFrame(table_questions(), "question_id long, question string")


def _questions_sql() -> str:
    return ("SELECT CAST(col0 AS BIGINT) AS question_id, col1 AS question FROM (VALUES "
            + ", ".join(f"({i}, {_sq(q)})" for i, q in table_questions()) + ")")


def sql_find(q: str, cols: list[str]) -> str:
    parts = [f"WHEN contains({q}, {_sq(c.lower())}) THEN {_sq(c)}" for c in cols]
    parts += [f"WHEN contains(translate({q}, '_-', '  '), {_sq(c.lower().replace('_', ' ').replace('-', ' '))}) "
              f"THEN {_sq(c)}" for c in cols]
    return "CASE " + " ".join(parts) + " END"


def sql_intent(q: str, nums: list[str], cats: list[str]) -> str:
    low = f"lower({q})"
    has = {n: "(" + " OR ".join(f"contains({low}, {_sq(w)})" for w in ws) + ")" for n, ws in V.INTENT_WORDS}
    num_ok = "true" if nums else "false"
    grp_ok = f"({'true' if (nums and cats) else 'false'} AND {sql_find(low, nums)} IS NOT NULL " \
             f"AND {sql_find(low, cats)} IS NOT NULL)"
    return (f"CASE WHEN {has['summary']} THEN 'summary' WHEN {has['missing']} THEN 'missing' "
            f"WHEN {has['columns']} THEN 'columns' WHEN {has['numeric']} THEN 'numeric' "
            f"WHEN {has['categorical']} THEN 'categorical' WHEN {has['total']} AND {num_ok} THEN 'total' "
            f"WHEN {has['average']} AND {num_ok} THEN 'average' WHEN {has['max']} AND {num_ok} THEN 'max' "
            f"WHEN {has['min']} AND {num_ok} THEN 'min' WHEN {has['grouped']} AND {grp_ok} THEN 'grouped' "
            f"ELSE 'help' END")


INTENTS_SQL = f"""
  SELECT question_id, intent,
         CASE WHEN intent IN ('total', 'average', 'max', 'min', 'grouped') THEN {sql_find('lower(question)', LI_NUM)} END AS metric,
         CASE WHEN intent = 'grouped' THEN {sql_find('lower(question)', LI_CAT)} END AS group_key
  FROM (SELECT *, {sql_intent('question', LI_NUM, LI_CAT)} AS intent FROM (__Q__))
"""


@query("question_intents", INTENTS_SQL.replace("__Q__", _questions_sql() + " UNION ALL " + USER_TURNS_SQL))
def q_question_intents(spark, sf):
    qs = _questions_df(spark).unionByName(user_turns(spark, sf))
    li = Tables(spark, sf).lineitem
    return routing.intents(qs, li).select("question_id", "intent", "metric", "group_key")


def _answers_sql() -> str:
    stats = ", ".join(
        f"coalesce(sum({c}), 0)::DOUBLE AS s_{c}, avg({c})::DOUBLE AS a_{c}, max({c})::DOUBLE AS x_{c}, "
        f"min({c})::DOUBLE AS n_{c}" for c in LI_NUM)
    miss = " + ".join(f"(count(*) - count({c}))" for c in LI_ALL)

    def pick(prefix):
        return "CASE metric " + " ".join(f"WHEN '{c}' THEN {prefix}_{c}" for c in LI_NUM) + " END"

    def all_text(prefix, head):
        return (f"'{head}' || chr(10) || " + " || ".join(
            f"'- {c}: ' || format('{{:,.2f}}', {prefix}_{c}) || chr(10)" for c in LI_NUM))

    help_text = _sq(routing.HELP_TEXT)
    summary = (f"chr(10) || 'Dataset Summary:' || chr(10) || '- Rows: ' || rows || chr(10) || "
               f"'- Columns: {len(LI_ALL)}' || chr(10) || '- Numeric columns: {', '.join(LI_NUM)}' || chr(10) || "
               f"'- Categorical columns: {', '.join(LI_CAT)}' || chr(10)")
    cols_text = "'Columns in the dataset:' || chr(10) || " + " || ".join(f"'- {c}' || chr(10)" for c in LI_ALL)
    num_text = "'Numeric columns:' || chr(10) || " + " || ".join(f"'- {c}' || chr(10)" for c in LI_NUM)
    cat_text = "'Categorical columns:' || chr(10) || " + " || ".join(f"'- {c}' || chr(10)" for c in LI_CAT)
    value = (f"CASE intent WHEN 'total' THEN {pick('s')} WHEN 'average' THEN {pick('a')} "
             f"WHEN 'max' THEN {pick('x')} WHEN 'min' THEN {pick('n')} END")
    scalar = (f"CASE intent WHEN 'total' THEN 'The total `' || metric || '` is ' "
              f"WHEN 'average' THEN 'The average `' || metric || '` is ' "
              f"WHEN 'max' THEN 'The highest value in `' || metric || '` is ' "
              f"ELSE 'The lowest value in `' || metric || '` is ' END || format('{{:,.2f}}', {value}) || '.'")
    grouped = "\n".join(
        f"UNION ALL SELECT '{k}' AS gk, '{m}' AS gm, string_agg(CAST({k} AS VARCHAR) || '=' || "
        f"format('{{:,.2f}}', v), '; ' ORDER BY v DESC, {k}) AS groups FROM (SELECT {k}, coalesce(sum({m}), 0)::DOUBLE AS v "
        f"FROM lineitem WHERE {k} IS NOT NULL GROUP BY {k} ORDER BY v DESC, {k} LIMIT 10)"
        for k, m in [("l_returnflag", "l_extendedprice"), ("l_linestatus", "l_quantity"),
                     ("l_linestatus", "l_discount")])
    return f"""
  WITH it AS ({INTENTS_SQL.replace('__Q__', _questions_sql())}),
  st AS (SELECT count(*) AS rows, {miss} AS missing, {stats} FROM lineitem),
  gr AS (SELECT NULL AS gk, NULL AS gm, NULL AS groups WHERE false {grouped})
  SELECT question_id, intent, metric, group_key, round({value}, 4) AS value,
    CASE intent WHEN 'summary' THEN {summary}
      WHEN 'missing' THEN CASE WHEN missing = 0 THEN 'No missing values were found in the dataset.' END
      WHEN 'columns' THEN {cols_text} WHEN 'numeric' THEN {num_text} WHEN 'categorical' THEN {cat_text}
      WHEN 'grouped' THEN 'Here is `' || metric || '` grouped by `' || group_key || '`.'
      WHEN 'help' THEN {help_text}
      ELSE CASE WHEN metric IS NOT NULL THEN {scalar}
                WHEN intent = 'total' THEN {all_text('s', 'Totals for numeric columns:')}
                WHEN intent = 'average' THEN {all_text('a', 'Averages for numeric columns:')}
                WHEN intent = 'max' THEN {all_text('x', 'Maximum values for numeric columns:')}
                ELSE {all_text('n', 'Minimum values for numeric columns:')} END END AS answer,
    gr.groups
  FROM it CROSS JOIN st LEFT JOIN gr ON gr.gk = it.group_key AND gr.gm = it.metric
"""


@query("answer_questions", _answers_sql())
def q_answer_questions(spark, sf):
    li = Tables(spark, sf).lineitem
    a = routing.answer_questions(_questions_df(spark), li)
    return a.select("question_id", "intent", "metric", "group_key", F.round("value", 4).alias("value"), "answer",
                    F.when(F.col("groups").isNotNull(), F.array_join(F.transform(
                        "groups", lambda g: F.concat(g["key"], F.lit("="), F.format_number(g["value"], 2))), "; "))
                    .alias("groups"))


#: What a stored reply looks like (by conversation and turn, modulo their number; null: the
#: turn's own text), and what must come out of it: intent, confidence, reasoning. A null intent
#: stands for the keyword route of the question.
FALLBACK_REASON = "Keyword fallback (LLM parse error)."
REPLIES = [
    (None, (None, 0.5, FALLBACK_REASON)),
    ('{"intent": "CSV", "confidence": 0.9, "reasoning": "numbers"}', ("csv", 0.9, "numbers")),
    ('```json\n{"intent": "pdf", "confidence": 1.7}\n```', ("pdf", 1.0, "")),
    ('{"intent": "maybe", "confidence": -0.5, "reasoning": "unsure"}', (None, 0.0, "unsure")),
    ('  {"confidence": 0.25, "other": [1, 2]}  ', ("pdf", 0.25, "")),
    ('```\n{"intent": "both"}\n```', ("both", 0.8, "")),
    ('{"intent": "csv", "confidence": null}', (None, 0.5, FALLBACK_REASON)),
    ('["csv", 0.9]', (None, 0.5, FALLBACK_REASON)),
    ('{"intent": "csv", "confidence": 0.9', (None, 0.5, FALLBACK_REASON)),
]


def _replies_sql() -> str:
    """The expected outcome of each kind of reply, without parsing any."""
    kind = f"((conv_id + turn) % {len(REPLIES)} + {len(REPLIES)}) % {len(REPLIES)}"

    def case(pick) -> str:
        return f"CASE {kind} " + " ".join(f"WHEN {i} THEN {pick(out)}" for i, (_, out) in enumerate(REPLIES)) + " END"

    return f"""
SELECT conv_id, turn, {case(lambda o: _sq(o[0]) if o[0] else sql_route('question'))} AS intent,
  CAST({case(lambda o: o[1])} AS DOUBLE) AS confidence, {case(lambda o: _sq(o[2]))} AS reasoning
FROM (SELECT a.conv_id, a.turn, u.text AS question FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
      WHERE a.role = 'assistant' AND u.role = 'user')
"""


@query("clean_responses", _replies_sql())
def q_clean_responses(spark, sf):
    cv = Tables(spark, sf).conversations
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(REPLIES)))
    raw = F.coalesce(F.element_at(F.array(*[F.lit(r).cast("string") for r, _ in REPLIES]), (kind + 1).cast("int")), F.col("text"))
    ans = cv.filter(F.col("role") == "assistant").select("conv_id", "turn", raw.alias("raw"))
    usr = cv.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                    F.col("text").alias("question"))
    pairs = ans.join(usr, ["conv_id", "turn"])
    return routing.clean_route_responses(pairs).select("conv_id", "turn", "intent", "confidence", "reasoning")


# ---------------------------------------------------------------- evaluation
ROUTE_ACC_SQL = f"""
  SELECT 'router' AS suite, coalesce(expected_route, 'all') AS slice,
         coalesce(sum(CAST(ok AS BIGINT)), 0) / count(*)::DOUBLE AS value,
         CAST(coalesce(sum(CAST(ok AS BIGINT)), 0) AS BIGINT) AS hits, count(*) AS total
  FROM (SELECT expected_route, {sql_route('question')} = expected_route AS ok FROM ({LABELLED_SQL}))
  GROUP BY ROLLUP (expected_route)
"""


def routed_labelled(spark, sf):
    lab = labelled_questions(spark, sf)
    return routing.route_questions(lab).withColumnRenamed("route", "actual_route")


@query("route_accuracy", ROUTE_ACC_SQL)
def q_route_accuracy(spark, sf):
    return E.route_accuracy(routed_labelled(spark, sf))


HIT_SQL = f"""
  WITH {bm25_sql(f'SELECT chunk_id, text FROM ({CHUNKS_SQL})',
                 'SELECT item_id AS question_id, text AS question FROM benchmark', 4)},
  joined AS (SELECT question_id, lower(string_agg(corp.text, ' ' ORDER BY lexical_rank)) AS al
             FROM lex JOIN corp USING (chunk_id) GROUP BY question_id),
  ex AS (SELECT question_id, list_filter({TOKENS_SQL.format(x='question')}, lambda t: length(t) >= 8) AS kws FROM qs),
  per AS (SELECT ex.question_id, coalesce(len(list_filter(kws, lambda k: contains(coalesce(al, ''), lower(k)))) > 0,
                                          false) AS hit
          FROM ex LEFT JOIN joined USING (question_id))
  SELECT 'retrieval' AS suite, 'all' AS slice, coalesce(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 0.0) AS value,
         count(*) FILTER (WHERE hit) AS hits, count(*) AS total FROM per
"""


def retrieval_hits(spark, sf):
    ch, idx = chunk_index(spark, sf)
    qs = Tables(spark, sf).benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    hits = lexical.lexical_topk(idx, qs, 4)
    with_text = fusion.with_chunks(hits, ch).select(
        "question_id", F.col("lexical_rank").alias("rank"), "text")
    from ..functions.text import tokens
    expected = qs.select("question_id", F.filter(tokens(F.col("question")), lambda t: F.length(t) >= 8)
                         .alias("keywords"))
    return E.hit_at_k(with_text, expected)


@query("hit_at_k", HIT_SQL)
def q_hit_at_k(spark, sf):
    return retrieval_hits(spark, sf)


CITE_SQL = """
  SELECT 'citation' AS suite, 'all' AS slice,
         coalesce(count(*) FILTER (WHERE regexp_matches(coalesce(text, ''), '(?i)\\(page\\s+\\d+\\)')) / count(*)::DOUBLE, 0.0) AS value,
         count(*) FILTER (WHERE regexp_matches(coalesce(text, ''), '(?i)\\(page\\s+\\d+\\)')) AS hits, count(*) AS total
  FROM (SELECT text FROM conversations WHERE role = 'assistant'
        UNION ALL SELECT claim || CASE WHEN claim_id % 2 = 1 THEN ' (Page ' || CAST(claim_id // 10 AS VARCHAR) || ').' ELSE '.' END
        FROM (__CLAIMS__))
""".replace("__CLAIMS__", CLAIMS_SQL)


def citations(spark, sf):
    """Over every assistant turn, and over an answer written from every claim:
    those with an odd number cite a page."""
    cv = Tables(spark, sf).conversations.filter(F.col("role") == "assistant").select("text")
    cite = F.concat(F.lit(" (Page "), F.expr("claim_id div 10").cast("string"), F.lit(")."))
    written = derived_claims(spark, sf).select(F.concat("claim", F.when(F.col("claim_id") % 2 == 1, cite)
                                                        .otherwise(F.lit("."))).alias("text"))
    return E.citation_rate(cv.unionByName(written), "text")


@query("citation_rate", CITE_SQL)
def q_citation_rate(spark, sf):
    return citations(spark, sf)


VERDICT_RESULTS_SQL = f"""
  SELECT c.claim_id, c.expected AS expected_verdict, v.verdict AS actual_verdict
  FROM ({CLAIMS_SQL}) c JOIN ({VERIFY_SQL}) v USING (claim_id) WHERE c.expected IS NOT NULL
"""
VERDICT_ACC_SQL = f"""
  SELECT 'claims' AS suite, coalesce(expected_verdict, 'all') AS slice,
         coalesce(sum(CAST(ok AS BIGINT)), 0) / count(*)::DOUBLE AS value,
         CAST(coalesce(sum(CAST(ok AS BIGINT)), 0) AS BIGINT) AS hits, count(*) AS total
  FROM (SELECT expected_verdict, expected_verdict = actual_verdict AS ok FROM ({VERDICT_RESULTS_SQL}))
  GROUP BY ROLLUP (expected_verdict)
"""


def verdict_results(spark, sf):
    exp = derived_claims(spark, sf).filter(F.col("expected").isNotNull()) \
        .select("claim_id", F.col("expected").alias("expected_verdict"))
    act = verified(spark, sf).select("claim_id", F.col("verdict").alias("actual_verdict"))
    return E.expected_vs_actual(exp, act, "claim_id")


@query("verdict_accuracy", VERDICT_ACC_SQL)
def q_verdict_accuracy(spark, sf):
    return E.verdict_accuracy(verdict_results(spark, sf))


@query("verdict_f1", "SELECT verdict, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, "
       "round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM ("
       "SELECT verdict, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS p, "
       "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS r FROM ("
       "SELECT d.verdict, count(*) FILTER (WHERE expected_verdict = d.verdict AND actual_verdict = d.verdict) AS tp, "
       "count(*) FILTER (WHERE expected_verdict <> d.verdict AND actual_verdict = d.verdict) AS fp, "
       "count(*) FILTER (WHERE expected_verdict = d.verdict AND actual_verdict <> d.verdict) AS fn "
       f"FROM (VALUES ('Supported'), ('Contradicted'), ('Unverifiable')) d(verdict), ({VERDICT_RESULTS_SQL}) "
       "GROUP BY d.verdict))")
def q_verdict_f1(spark, sf):
    out = E.verdict_f1(verdict_results(spark, sf))
    return out.select("verdict", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("evaluation_report", f"""
SELECT suite, slice, round(value, 6) AS value, hits, total FROM (
  {ROUTE_ACC_SQL} UNION ALL {HIT_SQL.replace('WITH ', 'SELECT * FROM (WITH ', 1)}) UNION ALL {CITE_SQL}
  UNION ALL {VERDICT_ACC_SQL})
""")
def q_evaluation_report(spark, sf):
    rep = E.evaluation_report(E.route_accuracy(routed_labelled(spark, sf)), retrieval_hits(spark, sf),
                              citations(spark, sf), E.verdict_accuracy(verdict_results(spark, sf)))
    return rep.select("suite", "slice", F.round("value", 6).alias("value"), "hits", "total")


# ---------------------------------------------------------------- insights and report
def _title(s: str) -> str:
    return s.title()


@query("insights", f"""
WITH t AS {CUSTOMER_ACTIVITY_SQL},
a AS (SELECT count(*) AS rows, coalesce(sum(c_custkey), 0)::DOUBLE AS t0, avg(c_custkey) AS a0,
             max(c_custkey)::DOUBLE AS x0, avg(c_acctbal) AS a1, min(c_acctbal)::DOUBLE AS n1,
             max(c_acctbal)::DOUBLE AS x1,
             {' + '.join(f'(count(*) - count({c}))' for c in
                         ['c_custkey', 'c_mktsegment', 'c_acctbal', 'n_orders', 'order_total', 'top_priority'])}
             AS missing FROM t),
g AS (SELECT c_mktsegment AS k, coalesce(sum(c_custkey), 0)::DOUBLE AS v FROM t WHERE c_mktsegment IS NOT NULL
      GROUP BY 1 ORDER BY v DESC, k LIMIT 1)
SELECT 1 AS ordinal, 'takeaway' AS kind, '{_title('c_custkey')} totals ' || format('{{:,.0f}}', t0) || ' across '
       || format('{{:,.0f}}', rows::DOUBLE) || ' records (avg ' || format('{{:,.1f}}', a0) || ', peak ' || format('{{:,.0f}}', x0)
       || ').' || ' {_title('c_acctbal')} averages ' || format('{{:,.1f}}', a1) || '.' AS text FROM a
UNION ALL SELECT 2, 'total', '{_title('c_custkey')} totals ' || format('{{:,.0f}}', t0) || ' with an average of '
       || format('{{:,.1f}}', a0) || ' per record.' FROM a
UNION ALL SELECT 3, 'range', '{_title('c_acctbal')} ranges from ' || format('{{:,.1f}}', n1) || ' to '
       || format('{{:,.1f}}', x1) || '.' FROM a
UNION ALL SELECT 5, 'shape', 'Dataset has ' || format('{{:,.0f}}', rows::DOUBLE) || ' rows × 6 columns with '
       || CASE WHEN missing = 0 THEN 'no' ELSE format('{{:,.0f}}', missing::DOUBLE) END || ' missing values.' FROM a
UNION ALL SELECT 4, 'top_group', k || ' is the top c_mktsegment by c_custkey (' || format('{{:,.0f}}', v) || ').' FROM g
""")
def q_insights(spark, sf):
    t = customer_activity(spark, sf)
    cat = profile.chart_categoricals(t).orderBy("ordinal").select("column").first()
    return report.insights(t, cat["column"] if cat else None)


REPORT_DATE = "December 02, 2026"


def _report_sql() -> str:
    km = LI_NUM
    key_rows = "\nUNION ALL ".join(
        f"SELECT 2, {9 + i}, '| {c} | ' || format('{{:,.2f}}', coalesce(sum({c}), 0)::DOUBLE) || ' | ' || "
        f"format('{{:,.2f}}', avg({c})) || ' | ' || format('{{:,.2f}}', max({c})::DOUBLE) || ' |' FROM lineitem"
        for i, c in enumerate(km))
    head = [("## Dataset Summary", 0), (None, 1), (f"- Columns: {len(LI_ALL)}", 2),
            (f"- Numeric columns: {', '.join(LI_NUM)}", 3), (f"- Categorical columns: {', '.join(LI_CAT)}", 4),
            ("", 5), ("## Key Metrics", 6), ("| Column | Total | Mean | Max |", 7),
            ("|--------|-------|------|-----|", 8)]
    head_sql = "\nUNION ALL ".join(
        (f"SELECT 2, {i}, '- Rows: ' || format('{{:,.0f}}', count(*)::DOUBLE) FROM lineitem" if t is None
         else f"SELECT 2, {i}, {_sq(t)}") for t, i in head)
    corpus = f"""
      SELECT count(*) AS pages, sum(16 + length(CAST(page_number AS VARCHAR)) + coalesce(length(text), 0)) AS characters,
             coalesce(sum(CASE WHEN text IS NOT NULL AND regexp_matches(text, '\\S') THEN ceil(length(text) / 650) END), 0)
               AS chunks FROM ({PAGES_SQL})"""
    return f"""
  WITH co AS ({corpus}), v AS ({VERIFY_SQL}),
  s(section, sub, line) AS (
    SELECT 0, 0, '# Executive Report' UNION ALL SELECT 0, 1, 'Generated: {REPORT_DATE}' UNION ALL SELECT 0, 2, ''
    UNION ALL SELECT 1, 0, '## Document Overview'
    UNION ALL SELECT 1, 1, '- Pages: ' || pages FROM co
    UNION ALL SELECT 1, 2, '- Characters indexed: ' || format('{{:,.0f}}', characters::DOUBLE) FROM co
    UNION ALL SELECT 1, 3, '- Searchable chunks: ' || CAST(chunks AS BIGINT) FROM co
    UNION ALL SELECT 1, 4, ''
    UNION ALL {head_sql}
    UNION ALL {key_rows}
    UNION ALL SELECT 2, {9 + len(km)}, ''
    UNION ALL SELECT 3, 0, '## Claim Verification Results'
    UNION ALL SELECT 3, 1, '| Claim | Verdict | Column | Actual Change |'
    UNION ALL SELECT 3, 2, '|-------|---------|--------|---------------|'
    UNION ALL SELECT 4, claim_id, '| ' || claim || ' | ' || verdict || ' | ' || coalesce(csv_metric, '—') || ' | '
                     || CASE WHEN actual_percent IS NULL THEN '—' ELSE printf('%+.2f%%', actual_percent) END || ' |' FROM v
    UNION ALL SELECT 5, 0, ''
    UNION ALL SELECT 9, 0, '---'
    UNION ALL SELECT 9, 1, '_Report generated automatically. Verify all claims independently before use._')
  SELECT row_number() OVER (ORDER BY section, sub) AS line_no, line FROM s
"""


@query("report_lines", _report_sql())
def q_report_lines(spark, sf):
    corpus = C.corpus_counts(doc_pages(spark, sf), 800, 150).agg(
        F.sum("pages").alias("pages"), F.sum("characters").alias("characters"), F.sum("chunks").alias("chunks"))
    li = Tables(spark, sf).lineitem
    return report.report_lines(REPORT_DATE, corpus, li, verified(spark, sf))


# ---------------------------------------------------------------- previews, truncation
@query("document_preview", "SELECT doc_id, substr(text, 1, 3000) AS preview, length(text) AS n_chars FROM documents")
def q_document_preview(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.substring("text", 1, 3000).alias("preview"), F.length("text").alias("n_chars"))


# (l_orderkey, l_linenumber) repeats in the given lineitem, so the preview
# orders by every shown column: a total order, the same rows in any engine
PREVIEW_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"]


@query("table_preview", f"""
SELECT {', '.join(PREVIEW_COLS)} FROM lineitem ORDER BY {', '.join(PREVIEW_COLS)} LIMIT 10
""")
def q_table_preview(spark, sf):
    li = Tables(spark, sf).lineitem.select(*PREVIEW_COLS)
    from ..operators.stats import truncate_rows
    return truncate_rows(li, PREVIEW_COLS, 10)


TRUNC_MARKER = "\n... (truncated)"


@query("truncated_context", f"""
{hybrid_sql(4)},
cx AS (SELECT question_id, string_agg('[Page ' || corp.page_number || ']' || chr(10) || corp.text, chr(10) || chr(10) ORDER BY rank) AS context
       FROM hy JOIN corp USING (chunk_id) GROUP BY question_id)
SELECT question_id, CASE WHEN length(context) > 1500 THEN substr(context, 1, 1500) || {_sq(TRUNC_MARKER)}
                         ELSE context END AS context FROM cx
""")
def q_truncated_context(spark, sf):
    corpus = hybrid_corpus(spark, sf)
    hits = fusion.hybrid(corpus, hybrid_questions(spark, sf), 4, hybrid_index(spark, sf))
    cx = fusion.context_blocks(fusion.with_chunks(hits, corpus))
    return cx.select("question_id", F.when(F.length("context") > 1500, F.concat(
        F.substring("context", 1, 1500), F.lit(TRUNC_MARKER))).otherwise(F.col("context")).alias("context"))


# ---------------------------------------------------------------- CSV source round trip
@query("csv_source", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, '{t}' AS dtype, '{k}' AS kind, count(*) AS rows, "
    f"count({c}) AS non_null, count(*) - count({c}) AS missing FROM {CUSTOMER_ACTIVITY_SQL} t"
    for i, (c, t, k) in enumerate([("c_custkey", "bigint", "numeric"), ("c_mktsegment", "string", "categorical"),
                                   ("c_acctbal", "double", "numeric"), ("n_orders", "bigint", "numeric"),
                                   ("order_total", "double", "numeric"), ("top_priority", "string", "categorical")])))
def q_csv_source(spark, sf):
    """Write the customer-activity table as CSV into the shared checkpoint
    folder, read it back with the CSV source (null tokens, numeric promotion,
    no date inference) and profile it."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, f"csv-source-{uuid.uuid4().hex}")
    customer_activity(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return profile.profile(read_metrics(spark, path))


@query("csv_quoted_lines", """
SELECT doc_id, md5(coalesce(text, '') || chr(10) || '"' || doc_id || '", ' || chr(10) || chr(10) || '""') AS digest,
       CASE WHEN lang <> '' THEN lang END AS lang FROM documents
""")
def q_csv_quoted_lines(spark, sf):
    """Every document's text, with a quoted tail over three lines, written as
    CSV into the shared folder and read back in splits (S1)."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"csv-quoted-{uuid.uuid4().hex}")
    tail = F.concat(F.lit('\n"'), F.col("doc_id").cast("string"), F.lit('", \n\n""'))
    docs = Tables(spark, sf).documents.select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("body"), "lang")
    (docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return read_metrics(spark, path).select("doc_id", F.md5("body").alias("digest"), "lang")


@query("report_parts", """
SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS place,
       '| ' || o_orderkey || ' | ' || o_orderpriority || ' |' AS line FROM orders
""")
def q_report_parts(spark, sf):
    """A line per order, written as parts of 10,000 line numbers, and read
    back in the order of the parts."""
    o = Tables(spark, sf).orders
    path = os.path.join(ensure_checkpoint_dir(spark), f"report-{uuid.uuid4().hex}")
    write_report(o.select(F.col("o_orderkey").alias("line_no"), F.concat(
        F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), "o_orderpriority", F.lit(" |")).alias("line")),
        path, part_lines=10_000)
    back = cut_lineage(read_report(spark, path).select("part", "at.block", "at.row", "line"), "report")
    return with_row_index(back, ["part", "block", "row"], "place").select("place", "line")
