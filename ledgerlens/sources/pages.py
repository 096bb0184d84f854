"""Page source (S2) and document assembly (S3).

A page table is ``(doc_id, page_number int 1-based, text)``. PDF byte decoding
is not built; any table of page texts is a page source, and whole documents
are cut into pages of a given number of characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pages_from_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         page_chars: int | None = None) -> DataFrame:
    """(doc_id, page_number, text), each page ``page_chars`` characters of its
    document (without it the whole text). A null or empty text is one such page."""
    text = F.col(text_col)
    if page_chars is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(1).alias("page_number"), text.alias("text"))
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / F.lit(page_chars)).cast("int") - 1)
    cut = F.transform(F.sequence(F.lit(0), last),
                      lambda p: F.substring(text, p * page_chars + 1, page_chars))
    return (docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut).alias("_p", "text"))
            .select("doc_id", (F.col("_p") + 1).alias("page_number"), "text"))


def assemble_documents(pages: DataFrame) -> DataFrame:
    """S3: one string per document: each page preceded by its marker, in page order.

    The result is inherently one value per document, so a document's pages meet
    in one group; the per-page operators (chunks, sentences, claims) never need
    this assembly and run on pages directly.
    """
    return (pages.groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("_p"))
            .select("doc_id",
                    F.array_join(F.transform("_p", lambda p: F.concat(
                        F.lit("\n\n--- Page "), p["page_number"].cast("string"), F.lit(" ---\n"),
                        F.coalesce(p["text"], F.lit("")))), "").alias("full_text")))
