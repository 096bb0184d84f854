"""Overlapping character chunks with sequential ids.

Per page, chunk starts are 0, step, 2*step, ... while start < len(text), with
step = size - overlap; every chunk is ``text[start:start+size]`` (the tail
chunk is kept even when it lies inside the previous one). Blank pages yield
nothing.

Ids: ``chunk_index`` runs over a document's pages in page order (the
reference numbering for one document) and ``chunk_id`` runs over all
documents in (doc_id, page_number) order. Both come from a prefix sum over
the narrow page-count table (closed form ceil(len/step) per page), never from
a window over chunk rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import cut_lineage
from .ordering import with_running_offset


def _check(size: int, overlap: int) -> int:
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be less than chunk_size ({size})")
    return size - overlap


def chunk_counts(pages: DataFrame, size: int = 800, overlap: float = 150) -> DataFrame:
    """Chunks per non-blank page: ceil(len / step)."""
    step = _check(size, overlap)
    return (pages.filter(~is_blank(F.col("text")))
            .select("doc_id", "page_number",
                    F.ceil(F.length("text") / F.lit(step)).cast("long").alias("n_chunks")))


def page_offsets(pages: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """(doc_id, page_number, n_chunks, chunk_id_start, chunk_index_start)."""
    # written first: the ranges are sampled from it, and the texts are not cut again for that
    counts = cut_lineage(chunk_counts(pages, size, overlap), "chunk-counts")
    glob = with_running_offset(counts, ["doc_id", "page_number"], "n_chunks", "chunk_id_start")
    # a document's chunks are contiguous, so its first global id is a min
    # (partial aggregate, safe for a document holding many pages)
    first = glob.groupBy("doc_id").agg(F.min("chunk_id_start").alias("_doc_start"))
    return (glob.join(first, "doc_id")
            .withColumn("chunk_index_start", F.col("chunk_id_start") - F.col("_doc_start"))
            .drop("_doc_start"))


def chunk_pages(pages: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """C1 + T4: (doc_id, page_number, chunk_index, chunk_id, start, text).

    The chunk texts are built inside one array per page (``transform`` over the
    start positions), so the page text is not copied once per chunk row.
    """
    step = _check(size, overlap)
    offsets = page_offsets(pages, size, overlap).select(
        "doc_id", "page_number", "chunk_id_start", "chunk_index_start")
    body = pages.filter(~is_blank(F.col("text"))).select("doc_id", "page_number", "text")
    pieces = F.transform(
        F.sequence(F.lit(0), F.length("text") - 1, F.lit(step)),
        lambda s: F.struct(s.alias("start"),
                           F.substring(F.col("text"), s + 1, size).alias("text")))
    # the narrow side is hashed, so the texts are not sorted
    exploded = (body.join(offsets.hint("shuffle_hash"), ["doc_id", "page_number"])
                .select("doc_id", "page_number", "chunk_id_start", "chunk_index_start",
                        F.posexplode(pieces).alias("pos", "piece")))
    return exploded.select(
        "doc_id", "page_number",
        (F.col("chunk_index_start") + F.col("pos")).alias("chunk_index"),
        (F.col("chunk_id_start") + F.col("pos")).alias("chunk_id"),
        F.col("piece.start").alias("start"),
        F.col("piece.text").alias("text"))


def corpus_counts(pages: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """A14 per document: pages, characters of the assembled text, searchable chunks."""
    step = _check(size, overlap)
    return (pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.lit(16) + F.length(F.col("page_number").cast("string"))
              + F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("characters"),
        F.coalesce(F.sum(F.when(~is_blank(F.col("text")),
                                F.ceil(F.length("text") / F.lit(step)))), F.lit(0))
        .cast("long").alias("chunks")))
