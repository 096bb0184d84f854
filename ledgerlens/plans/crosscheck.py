"""Cross-check questions against documents and a metric table.

For every question: the claims relevant to it (J7, fallback to the first
four), each verified against the metric table (L5), and the question's
supporting evidence pages from hybrid retrieval with k = 3 (L3 -> A13).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims as CL
from ..operators import fusion

EVIDENCE_K = 3


def cross_check(questions: DataFrame, claims: DataFrame, metrics: DataFrame, order_col: str,
                corpus: DataFrame | None = None, k: int = EVIDENCE_K, index=None) -> tuple[DataFrame, DataFrame | None]:
    """Returns (verdicts per question and claim, evidence pages per question).

    ``questions``: (question_id, question[, vector]); ``claims``: (claim_id,
    claim); ``corpus``: (chunk_id, doc_id, page_number, text, vector) or None,
    ``index``: the lexical index over it, if there is one already.
    Each distinct claim is verified once, then joined to the questions that
    selected it.
    """
    rel = CL.relevant_claims(questions.select("question_id", "question"), claims, 4)
    picked = rel.select("claim_id").distinct().join(claims, "claim_id")
    verdicts = CL.verify(picked, metrics, order_col)
    out = rel.select("question_id", "claim_id", "fallback").join(verdicts, "claim_id")
    evidence = None
    if corpus is not None and "vector" in questions.columns:
        hits = fusion.hybrid(corpus.select("chunk_id", "text", "vector"), questions, k, index)
        evidence = fusion.evidence_pages(fusion.with_chunks(hits, corpus))
    return out, evidence
