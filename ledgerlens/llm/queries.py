"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import decontaminate as dec
from . import host_trust as ht
from . import jaccard_join as jj
from . import language_id as lid
from . import license_scan as ls
from . import line_dedup as ld
from . import nn_descent as nn
from . import packing as pk
from . import prefix_free as pf
from . import source_audit as sa
from . import token_align as ta
from . import topk as tk
from . import toxicity as tx
from .common import held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL_LINE_DEDUP = """
WITH l AS MATERIALIZED (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
p AS MATERIALIZED (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS x FROM l),
r AS MATERIALIZED (
  SELECT doc_id, i, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y,
         lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM p),
f AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, i) AS nth FROM r WHERE j IS NOT NULL) WHERE nth > 1),
g AS MATERIALIZED (SELECT doc_id, i FROM f UNION SELECT doc_id, i + 1 FROM f),
k AS (SELECT doc_id, count(g.i) AS n_removed,
             sum(CASE WHEN g.i IS NOT NULL AND (doc_id, p.i - 1) NOT IN (SELECT (doc_id, i) FROM g) THEN 1 ELSE 0 END) AS n_runs,
             string_agg(x, chr(10) ORDER BY p.i) FILTER (WHERE g.i IS NULL) AS kept
      FROM p LEFT JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op1_line_dedup", SQL_LINE_DEDUP)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ld.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL_DECONTAMINATE = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i
        FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS MATERIALIZED (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op3_decontaminate", SQL_DECONTAMINATE)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dec.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL_TOPK = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""


@query("op5_topk_search", SQL_TOPK)
def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = lid.train(docs)
    return (lid.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))


#: The vocabulary file that the packing query counts tokens with.
TOKENIZER = "byte_bpe_50k.json"


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pk.pack(pk.pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


@query("op10_prefix_free")
def op10_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.dedup(read_table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


SQL_JACCARD = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, least(3, len(w)) AS k, unnest(generate_series(1, len(w) - least(3, len(w)) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT x, y FROM both_in JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)
  UNION SELECT y, x FROM both_in JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(o) FROM r WHERE r.doc_id = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""


@query("op4_jaccard_join", SQL_JACCARD)
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jj.join(read_table(spark, sf_dir, "documents"))


def sql_host_trust() -> str:
    """The rules and the propagation with one CTE a round."""
    fits = []
    for verdict, host, path in sorted(ht.RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")):
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')", host + path, verdict))
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    ruling = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    rounds = ["r0 AS MATERIALIZED (SELECT host, t0, d0, t0 AS t, d0 AS d FROM seeds)"]
    for i in range(ht.ROUNDS):
        rounds.append(f"""r{i + 1} AS MATERIALIZED (
  SELECT s.host, s.t0, s.d0, {1 - ht.DAMPING!r} * s.t0 + {ht.DAMPING} * coalesce(ti, 0) AS t, {1 - ht.DAMPING!r} * s.d0 + {ht.DAMPING} * coalesce(di, 0) AS d
  FROM seeds s
  LEFT JOIN (SELECT dst, sum(t / deg) AS ti FROM e JOIN od USING (src) JOIN r{i} ON host = src GROUP BY dst) a ON a.dst = s.host
  LEFT JOIN (SELECT src, sum(d / deg) AS di FROM e JOIN id USING (dst) JOIN r{i} ON host = dst GROUP BY src) b ON b.src = s.host)""")
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWERED}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
p AS MATERIALIZED (SELECT *, CASE {rule} END AS rule, CASE {ruling} END AS ruling FROM h),
seeds AS MATERIALIZED (
  SELECT host, CASE WHEN avg(CASE WHEN ruling = 'allow' THEN 1.0 ELSE 0.0 END) > {ht.SEED_SHARE} THEN 1.0::DOUBLE ELSE 0.0 END AS t0,
         CASE WHEN avg(CASE WHEN ruling = 'block' THEN 1.0 ELSE 0.0 END) > {ht.SEED_SHARE} THEN 1.0::DOUBLE ELSE 0.0 END AS d0
  FROM p WHERE host <> '' GROUP BY host),
x AS (SELECT host AS src, unnest(regexp_extract_all(html, 'href\s*=\s*["'']((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]*)', 1, 'i')) AS href FROM p WHERE host <> ''),
up AS (SELECT host AS src, substr(host, instr(host, '.') + 1) AS dst FROM seeds WHERE instr(host, '.') > 0),
e AS MATERIALIZED (
  SELECT DISTINCT src, dst FROM (
    SELECT src, translate(regexp_extract(substr(href, instr(href, '//') + 2), '^([^/?#]*)', 1), '{UPPER}', '{LOWERED}') AS dst FROM x
    UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up)
  WHERE src <> dst AND src IN (SELECT host FROM seeds) AND dst IN (SELECT host FROM seeds)),
od AS (SELECT src, count(*) AS deg FROM e GROUP BY src),
id AS (SELECT dst, count(*) AS deg FROM e GROUP BY dst),
{(","+chr(10)).join(rounds)}
SELECT page_id, host, path, rule,
       coalesce(ruling, CASE WHEN d > 0 AND d >= {ht.THRESHOLD} * (t + d) THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN r{ht.ROUNDS} USING (host)
"""


@query("op2_host_trust", sql_host_trust())
def op2_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ht.judge(read_table(spark, sf_dir, "pages")).drop("trust", "distrust")


def sql_licenses() -> str:
    """Containment of at least 80 % of a template's shingles in a document."""
    shingles = {name: ls.template_shingles(t, word=ls.STOPPED) for name, t in ls.TEMPLATES}
    rows = ", ".join(f"('{name}', {len(own)}, '{s}')" for name, own in shingles.items() for s in own)
    return rf"""
WITH t(name, m, s) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9.]+') AS w FROM documents),
k AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d)),
f AS (SELECT doc_id, name FROM k JOIN t USING (s) GROUP BY doc_id, name, m HAVING 100 * count(*) >= {ls.CONTAINMENT} * m)
SELECT doc_id, count(name) AS n_licenses, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses
FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id
"""


@query("op7_license_scan", sql_licenses())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ls.scan(read_table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tx.score(docs, tx.train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


SQL_SOURCES = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWERED}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS item FROM d),
k AS MATERIALIZED (SELECT lang, item, count(*) AS all_n FROM t GROUP BY lang, item HAVING count(DISTINCT r) >= 3),
c AS MATERIALIZED (SELECT lang, source, item, count(*) AS n FROM t JOIN k USING (lang, item) GROUP BY lang, source, item),
v AS (SELECT lang, count(*) AS v, sum(all_n) AS l FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS MATERIALIZED (
  SELECT s.lang, s.source, k.item, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.total + v.v) AS p, 1 + 1000000000::HUGEINT * (k.all_n + 1) // (v.l + v.v) AS q
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.item = k.item),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.item = b.item AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', item, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_audit", SQL_SOURCES)
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sa.audit(read_table(spark, sf_dir, "documents"))


#: The piece vocabulary that byte-level tokens are aligned with.
PIECES = "piece_bpe_32k.model"


@query("op12_token_align")
def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ta.align(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


@query("op13_nearest")
def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn.neighbours(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
