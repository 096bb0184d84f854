"""Rank fusion, hybrid retrieval, page evidence and context (J1, U1, M1, T3,
J4, A13, M4, N1, L3).

Fusion unions the two candidate lists and sums the weighted reciprocal-rank
contributions per (question, chunk) in one aggregation; ids and scores are
carried through ranking and the chunk text is joined last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import dense, lexical

# Reciprocal-rank constant and the fusion weights.
RRF_K = 60
DENSE_WEIGHT = 0.6
LEXICAL_WEIGHT = 0.4
OVERFETCH = 3


def rrf(rank) -> F.Column:
    """M1: 1 / (60 + rank)."""
    return F.lit(1.0) / (F.lit(RRF_K) + rank)


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, k: int = 4,
         dense_weight: float = DENSE_WEIGHT, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """J1/U1 + T3: (question_id, chunk_id, hybrid_score, rank, dense_distance,
    dense_rank, lexical_score, lexical_rank).

    Order: hybrid score desc, then dense hits in dense order, then
    lexical-only hits in lexical order (the insertion order of the reference).
    """
    d = dense_hits.select("question_id", "chunk_id", "dense_distance", "dense_rank",
                          F.lit(None).cast("double").alias("lexical_score"),
                          F.lit(None).cast("int").alias("lexical_rank"))
    lx = lexical_hits.select("question_id", "chunk_id",
                             F.lit(None).cast("double").alias("dense_distance"),
                             F.lit(None).cast("int").alias("dense_rank"),
                             "lexical_score", "lexical_rank")
    merged = (d.unionByName(lx).groupBy("question_id", "chunk_id").agg(
        F.max("dense_distance").alias("dense_distance"), F.min("dense_rank").alias("dense_rank"),
        F.max("lexical_score").alias("lexical_score"), F.min("lexical_rank").alias("lexical_rank")))
    score = (F.coalesce(dense_weight * rrf(F.col("dense_rank")), F.lit(0.0))
             + F.coalesce(lexical_weight * rrf(F.col("lexical_rank")), F.lit(0.0)))
    w = Window.partitionBy("question_id").orderBy(
        F.col("hybrid_score").desc(), F.col("dense_rank").asc_nulls_last(),
        F.col("lexical_rank").asc_nulls_last())
    return (merged.withColumn("hybrid_score", F.round(score, 9))
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def hybrid(corpus: DataFrame, questions: DataFrame, k: int = 4,
           index: lexical.LexicalIndex | None = None, overfetch: int = OVERFETCH) -> DataFrame:
    """L3: dense top 3k and lexical top 3k per question, fused to the top k.

    ``corpus``: (chunk_id, text, vector); ``questions``: (question_id,
    question, vector). With no lexical index and no corpus text, the dense
    ranking alone is returned, ranks 1..k.
    """
    cand = k * overfetch
    if index is None and "text" not in corpus.columns:
        return dense.nearest(corpus, questions, k).withColumnRenamed("dense_rank", "rank")
    dense_hits = dense.nearest(corpus, questions, cand)
    idx = index or lexical.build_index(corpus.select("chunk_id", "text"))
    lex_hits = lexical.lexical_topk(idx, questions.select("question_id", "question"), cand)
    return fuse(dense_hits, lex_hits, k)


def relevance_label(distance) -> F.Column:
    """M4: similarity 1/(1+d): >= 0.45 high, >= 0.30 medium, else low.
    Hits without a dense distance (lexical-only) are 'unscored'."""
    sim = F.lit(1.0) / (F.lit(1.0) + distance)
    return (F.when(distance.isNull(), F.lit("unscored"))
            .when(sim >= 0.45, F.lit("high relevance"))
            .when(sim >= 0.30, F.lit("medium relevance"))
            .otherwise(F.lit("low relevance")))


def with_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach page number and text to hits, after the top-k cut. The hits are
    written first: while they are few they are broadcast, and no text is shuffled."""
    kept = [c for c in ("chunk_id", "doc_id", "page_number", "text") if c in chunks.columns]
    return lexical.small(cut_lineage(hits, "hits")).join(chunks.select(*kept), "chunk_id")


def evidence_pages(hits_with_text: DataFrame) -> DataFrame:
    """Per question and page: texts in hit order, best (smallest) distance,
    relevance label; one row per (question, document, page)."""
    g = (hits_with_text.groupBy("question_id", "doc_id", "page_number")
         .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_h"),
              F.min("dense_distance").alias("best_distance"),
              F.count(F.lit(1)).alias("n_chunks")))
    return g.select("question_id", "doc_id", "page_number",
                    F.transform("_h", lambda h: h["text"]).alias("texts"),
                    "best_distance", relevance_label(F.col("best_distance")).alias("label"),
                    "n_chunks")


def context_blocks(hits_with_text: DataFrame) -> DataFrame:
    """Per question, ``[Page N]\\ntext`` blocks in hit order joined by a blank line."""
    g = hits_with_text.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "page_number", "text"))).alias("_h"))
    return g.select("question_id", F.array_join(F.transform("_h", lambda h: F.concat(
        F.lit("[Page "), h["page_number"].cast("string"), F.lit("]\n"), h["text"])), "\n\n")
        .alias("context"))
