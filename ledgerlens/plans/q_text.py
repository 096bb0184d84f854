"""Registered queries: pages, chunks, tokens, sentences and retrieval.

Corpora (all rows of the given tables):
* pages = every ``documents`` row cut into pages of 2,000 characters; chunks 800/150.
* lexical search: every ``benchmark`` item as a question over every chunk.
* dense search: every ``embeddings`` vector as a question over all vectors.
* hybrid: every chunk of every document is searched by words; a document's
  vector (``doc_id = vec_id``), if it has one, stands at its first chunk and is
  searched too. Every benchmark item is a question, with its vector
  (``item_id = vec_id``) if there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import dense, fusion, lexical
from ..sources.pages import assemble_documents, pages_from_documents
from ..session import cut_lineage, files_version, shared
from ..sources.tables import Tables
from .registry import query

SIZE, OVERLAP = 800, 150
STEP = SIZE - OVERLAP
PAGE_CHARS = 2000


def doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages_from_documents(Tables(spark, sf).documents, page_chars=PAGE_CHARS)


def doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunk_pages(doc_pages(spark, sf), SIZE, OVERLAP)


def _corpus_key(spark: SparkSession, sf: str, what: str) -> tuple:
    t = Tables(spark, sf)
    return (what, sf, PAGE_CHARS, SIZE, OVERLAP, files_version(t.documents, t.embeddings))


def written_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_chunks`` without the starts, written once an application."""
    return shared(spark, _corpus_key(spark, sf, "written chunks"), lambda: cut_lineage(
        doc_chunks(spark, sf).select("doc_id", "page_number", "chunk_index", "chunk_id", "text"), "chunks"))


def chunk_index(spark: SparkSession, sf: str) -> tuple[DataFrame, lexical.LexicalIndex]:
    """(chunk_id, text) of every chunk and the index over them, written once an
    application: every lexical query reads the same."""
    def build():
        chunks = written_chunks(spark, sf).select("chunk_id", "text")
        return chunks, lexical.build_index(chunks)

    return shared(spark, _corpus_key(spark, sf, "chunks"), build)


def hybrid_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, page_number, chunk_id, text, vector), written once an application:
    both searches and the look-up of the hits read it."""
    def build():
        vectors = Tables(spark, sf).embeddings.select(F.col("vec_id").alias("doc_id"),
                                                      F.lit(0).cast("long").alias("chunk_index"),
                                                      F.col("embedding").alias("vector"))
        # only first chunks meet the vectors: the other texts are not shuffled for them
        chunks = written_chunks(spark, sf)
        first = cut_lineage(chunks.filter(F.col("chunk_index") == 0).join(vectors, ["doc_id", "chunk_index"], "left"), "first-chunks")
        out = ["doc_id", "page_number", "chunk_id", "text"]
        others = chunks.filter(F.col("chunk_index") != 0).select(*out, F.lit(None).cast(vectors.schema["vector"].dataType).alias("vector"))
        return others.unionByName(first.select(*out, "vector"))

    return shared(spark, _corpus_key(spark, sf, "hybrid corpus"), build)


def hybrid_index(spark: SparkSession, sf: str) -> lexical.LexicalIndex:
    """The index over ``hybrid_corpus``, written once an application."""
    return shared(spark, _corpus_key(spark, sf, "hybrid index"),
                  lambda: lexical.build_index(hybrid_corpus(spark, sf).select("chunk_id", "text")))


def hybrid_questions(spark: SparkSession, sf: str) -> DataFrame:
    t = Tables(spark, sf)
    return t.benchmark.select(F.col("item_id").alias("question_id"), F.col("text").alias("question")) \
        .join(t.embeddings.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")),
              "question_id", "left")


# ---------------------------------------------------------------- SQL pieces
PAGES_SQL = f"""SELECT doc_id, CAST(p AS INTEGER) AS page_number,
    substr(text, (p - 1) * {PAGE_CHARS} + 1, {PAGE_CHARS}) AS text
  FROM (SELECT doc_id, text, unnest(generate_series(1,
          greatest(1, coalesce(CAST(ceil(length(text) / {PAGE_CHARS}) AS BIGINT), 1)))) AS p FROM documents)"""
TOKENS_SQL = "list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda t: t <> '')"
CHUNKS_SQL = f"""
  WITH p AS ({PAGES_SQL}),
  n AS (SELECT doc_id, page_number, text, CAST(ceil(length(text) / {STEP}) AS BIGINT) AS n
        FROM p WHERE text IS NOT NULL AND regexp_matches(text, '\\S')),
  o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY doc_id, page_number
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS id0,
               coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY page_number
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx0 FROM n),
  s AS (SELECT doc_id, page_number, id0, idx0, text, unnest(range(0, length(text), {STEP})) AS start FROM o)
  SELECT doc_id, page_number, idx0 + start // {STEP} AS chunk_index, id0 + start // {STEP} AS chunk_id,
         start, substr(text, start + 1, {SIZE}) AS text FROM s
"""


def bm25_sql(corpus: str, questions: str, k: int) -> str:
    """SQL BM25 top-k: ``corpus`` has (chunk_id, text), ``questions`` (question_id, question)."""
    return f"""
  corp AS MATERIALIZED ({corpus}),
  tok AS MATERIALIZED (SELECT chunk_id, {TOKENS_SQL.format(x='text')} AS t FROM corp),
  post AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS term FROM tok) GROUP BY ALL),
  dl AS (SELECT chunk_id, len(t) AS dl FROM tok),
  st AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM tok),
  dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
  raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, st),
  idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
  qs AS ({questions}),
  qt AS (SELECT question_id, term, count(*) AS qtf FROM
           (SELECT question_id, unnest({TOKENS_SQL.format(x='question')}) AS term FROM qs) GROUP BY ALL),
  sc AS (SELECT qt.question_id, post.chunk_id,
           round(sum(qtf * idf.idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl))), 6) AS lexical_score
         FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (chunk_id), st
         GROUP BY ALL),
  lex AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY lexical_score DESC, chunk_id) AS lexical_rank
          FROM sc QUALIFY lexical_rank <= {k})"""


def dense_sql(corpus: str, questions: str, k: int) -> str:
    """``corpus``: (chunk_id, vector); ``questions``: (question_id, vector)."""
    return f"""
  dc AS ({corpus}), dq AS ({questions}),
  dd AS (SELECT dq.question_id, dc.chunk_id,
           round(list_sum(list_transform(list_zip(dq.vector::DOUBLE[], dc.vector::DOUBLE[]),
                 lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) + 0.0 AS dense_distance
         FROM dq, dc),
  den AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY dense_distance, chunk_id) AS dense_rank
          FROM dd QUALIFY dense_rank <= {k})"""


HYB_CORPUS = f"""SELECT doc_id, page_number, chunk_id, text, embedding AS vector
  FROM ({CHUNKS_SQL}) LEFT JOIN embeddings ON doc_id = vec_id AND chunk_index = 0"""
HYB_QUESTIONS = ("SELECT item_id AS question_id, text AS question, embedding AS vector "
                 "FROM benchmark LEFT JOIN embeddings ON item_id = vec_id")


def hybrid_sql(k: int, questions: str = HYB_QUESTIONS) -> str:
    return f"""
  WITH {bm25_sql(HYB_CORPUS, questions, 3 * k)},
  {dense_sql('SELECT chunk_id, vector FROM corp WHERE vector IS NOT NULL',
             'SELECT question_id, vector FROM qs WHERE vector IS NOT NULL', 3 * k)},
  fu AS (SELECT coalesce(den.question_id, lex.question_id) AS question_id,
                coalesce(den.chunk_id, lex.chunk_id) AS chunk_id,
                dense_distance, dense_rank, lexical_score, lexical_rank,
                round(coalesce(0.6 / (60 + dense_rank), 0.0) + coalesce(0.4 / (60 + lexical_rank), 0.0), 9) AS hybrid_score
         FROM den FULL OUTER JOIN lex ON den.question_id = lex.question_id AND den.chunk_id = lex.chunk_id),
  hy AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hybrid_score DESC,
                    dense_rank ASC NULLS LAST, lexical_rank ASC NULLS LAST) AS rank
         FROM fu QUALIFY rank <= {k})"""


def _ranked_longs(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- pages, text
@query("page_filter", f"""
SELECT doc_id, page_number, length(text) AS n_chars FROM ({PAGES_SQL})
WHERE text IS NOT NULL AND regexp_matches(text, '\\S')
""")
def q_page_filter(spark, sf):
    p = doc_pages(spark, sf)
    return p.filter(~T.is_blank(F.col("text"))).select(
        "doc_id", "page_number", F.length("text").alias("n_chars"))


@query("document_assembly", f"""
SELECT doc_id, string_agg('\n\n--- Page ' || page_number || ' ---\n' || coalesce(text, ''), '' ORDER BY page_number) AS full_text
FROM ({PAGES_SQL}) GROUP BY doc_id
""")
def q_document_assembly(spark, sf):
    return assemble_documents(doc_pages(spark, sf))


@query("chunks", CHUNKS_SQL)
def q_chunks(spark, sf):
    return doc_chunks(spark, sf)


@query("tokens", f"""
SELECT chunk_id, CAST(len({TOKENS_SQL.format(x='text')}) AS INTEGER) AS n_tokens,
       {TOKENS_SQL.format(x='text')}[1] AS first_token
FROM ({CHUNKS_SQL})
""")
def q_tokens(spark, sf):
    ch = doc_chunks(spark, sf)
    tk = T.tokens(F.col("text"))
    return ch.select("chunk_id", F.size(tk).alias("n_tokens"), F.get(tk, 0).alias("first_token"))


SENTENCES_SQL = f"""
  WITH parts AS (SELECT doc_id, page_number,
      string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM ({PAGES_SQL})),
  ex AS (SELECT doc_id, page_number, unnest(ss) AS raw, unnest(generate_series(0, len(ss) - 1)) AS pos FROM parts)
  SELECT doc_id, page_number, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS sentence FROM ex
"""


@query("sentences", f"""
SELECT * FROM ({SENTENCES_SQL}) WHERE length(sentence) BETWEEN 15 AND 250
""")
def q_sentences(spark, sf):
    p = doc_pages(spark, sf)
    s = p.select("doc_id", "page_number", F.posexplode(T.sentences(F.col("text"))).alias("pos", "raw"))
    s = s.select("doc_id", "page_number", F.col("pos").cast("long").alias("pos"),
                 T.strip(F.col("raw")).alias("sentence"))
    return s.filter(T.length_between(F.col("sentence"), 15, 250))


@query("corpus_counts", f"""
SELECT doc_id, count(*) AS pages,
  CAST(sum(16 + length(CAST(page_number AS VARCHAR)) + coalesce(length(text), 0)) AS BIGINT) AS characters,
  CAST(coalesce(sum(CASE WHEN text IS NOT NULL AND regexp_matches(text, '\\S')
                         THEN ceil(length(text) / {STEP}) END), 0) AS BIGINT) AS chunks
FROM ({PAGES_SQL}) GROUP BY doc_id
""")
def q_corpus_counts(spark, sf):
    return C.corpus_counts(doc_pages(spark, sf), SIZE, OVERLAP)


# ---------------------------------------------------------------- retrieval
@query("lexical_stats", f"""
WITH tok AS MATERIALIZED (SELECT {TOKENS_SQL.format(x='text')} AS t FROM ({CHUNKS_SQL})),
  dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM tok) GROUP BY term),
  raw AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM tok) - df + 0.5) - ln(df + 0.5) AS r FROM dfs)
SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END, 6) AS idf FROM raw
""")
def q_lexical_stats(spark, sf):
    _, idx = chunk_index(spark, sf)
    return idx.terms.select("term", "df", F.round("idf", 6).alias("idf"))


LEXICAL_SQL = f"""
WITH {bm25_sql(f'SELECT chunk_id, text FROM ({CHUNKS_SQL})',
               'SELECT item_id AS question_id, text AS question FROM benchmark', 12)}
SELECT question_id, chunk_id, lexical_score, lexical_rank FROM lex
"""


def _lexical(spark, sf, skip: bool):
    _, idx = chunk_index(spark, sf)
    qs = Tables(spark, sf).benchmark.select(F.col("item_id").alias("question_id"),
                                            F.col("text").alias("question"))
    return _ranked_longs(lexical.lexical_topk(idx, qs, 12, skip=skip), ["lexical_rank"])


@query("lexical_topk", LEXICAL_SQL)
def q_lexical_topk(spark, sf):
    return _lexical(spark, sf, skip=False)


@query("lexical_topk_skipping", LEXICAL_SQL)
def q_lexical_topk_skipping(spark, sf):
    return _lexical(spark, sf, skip=True)


@query("dense_topk", f"""
WITH {dense_sql('SELECT vec_id AS chunk_id, embedding AS vector FROM embeddings',
                'SELECT vec_id AS question_id, embedding AS vector FROM embeddings', 4)}
SELECT question_id, chunk_id, dense_distance, dense_rank FROM den
""")
def q_dense_topk(spark, sf):
    e = Tables(spark, sf).embeddings
    hits = dense.nearest(e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")),
                         e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")), 4)
    return _ranked_longs(hits, ["dense_rank"])


HYBRID_COLS = ("question_id, chunk_id, rank, hybrid_score, dense_distance, dense_rank, "
               "lexical_score, lexical_rank")


@query("hybrid_topk", f"""
{hybrid_sql(4)}
SELECT {HYBRID_COLS} FROM hy
""")
def q_hybrid_topk(spark, sf):
    hits = fusion.hybrid(hybrid_corpus(spark, sf), hybrid_questions(spark, sf), 4, hybrid_index(spark, sf))
    return _ranked_longs(hits.select(*[c.strip() for c in HYBRID_COLS.split(",")]),
                         ["rank", "dense_rank", "lexical_rank"])


EVIDENCE_SQL_TAIL = """,
ht AS (SELECT hy.*, corp.text, corp.doc_id, corp.page_number FROM hy JOIN corp USING (chunk_id))
SELECT question_id, doc_id, page_number, list(text ORDER BY rank) AS texts,
  min(dense_distance) AS best_distance,
  CASE WHEN min(dense_distance) IS NULL THEN 'unscored'
       WHEN 1.0 / (1.0 + min(dense_distance)) >= 0.45 THEN 'high relevance'
       WHEN 1.0 / (1.0 + min(dense_distance)) >= 0.30 THEN 'medium relevance'
       ELSE 'low relevance' END AS label,
  count(*) AS n_chunks
FROM ht GROUP BY question_id, doc_id, page_number
"""


@query("evidence_pages", hybrid_sql(3) + EVIDENCE_SQL_TAIL)
def q_evidence_pages(spark, sf):
    corpus = hybrid_corpus(spark, sf)
    hits = fusion.hybrid(corpus, hybrid_questions(spark, sf), 3, hybrid_index(spark, sf))
    return fusion.evidence_pages(fusion.with_chunks(hits, corpus))


@query("context_blocks", f"""
{hybrid_sql(4)}
SELECT question_id, string_agg('[Page ' || corp.page_number || ']' || chr(10) || corp.text, chr(10) || chr(10) ORDER BY rank) AS context
FROM hy JOIN corp USING (chunk_id) GROUP BY question_id
""")
def q_context_blocks(spark, sf):
    corpus = hybrid_corpus(spark, sf)
    hits = fusion.hybrid(corpus, hybrid_questions(spark, sf), 4, hybrid_index(spark, sf))
    return fusion.context_blocks(fusion.with_chunks(hits, corpus))
