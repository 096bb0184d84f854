"""Claim candidates over a stream of documents.

The reference has no streaming code. The per-row text operators (sentence
split, length filter, qualification, change and window parsing) are plain
projections, so they run unchanged on a streaming DataFrame; the
first-occurrence dedup and the cap of 8 per document need a complete
document and stay batch operators. New documents arriving as parquet files
are turned into candidate claims incrementally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import claims as CF
from ..operators.claims import candidate_sentences
from ..sources.pages import pages_from_documents

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, path: str, schema: str = DOC_SCHEMA,
                    max_files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def claim_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, page_number, pos, sentence, pct, direction, window) per
    qualifying sentence; works on batch and streaming inputs alike."""
    s = candidate_sentences(pages_from_documents(docs)).select(
        "doc_id", "page_number", "pos", "sentence",
        CF.change(F.col("sentence")).alias("_c"), CF.time_window(F.col("sentence")).alias("_w"))
    return s.select("doc_id", "page_number", "pos", "sentence", F.col("_c.pct").alias("pct"),
                    F.col("_c.direction").alias("direction"), F.col("_w.type").alias("window_type"),
                    F.col("_w.value").alias("window_value"))


def start(candidates: DataFrame, sink_path: str, checkpoint_location: str) -> StreamingQuery:
    """Append candidates to a parquet sink; the checkpoint makes restarts
    exactly-once for the file sink."""
    return (candidates.writeStream.format("parquet").option("path", sink_path)
            .option("checkpointLocation", checkpoint_location).outputMode("append").start())
