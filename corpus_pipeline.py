"""Corpus pipeline: language ID, line dedup, Jaccard join, decontamination, packing.

Every stage takes (spark, docs, sf_dir), applies one operator of ledgerlens.llm
to all of ``docs`` and returns a DataFrame; the stages between are written as
Parquet and read again. All but the last return the columns of ``documents``;
the last returns the packed pieces.

* language_id drops documents without a language (no text, no letter, or no
  language that is likelier than the others together).
* line_dedup deletes later copies of runs of two lines, and of single lines of
  50 words or more (op1 itself: runs of two lines); documents of which nothing is
  left go.
* jaccard_join keeps one row of every group of linked ones: the smallest doc_id,
  null ids last (of rows of one id, the least row key). Rows are told apart by a
  128-bit key of all their columns, not by id; rows without words stay. Documents link when their sets of 5-word
  shingles reach a Jaccard similarity of 0.8 (op4 itself: 3 words, 0.9).
* decontaminate drops documents that hold a window of a benchmark item.
* packing packs what is left.

ORACLE_SQL is None: the byte trees and the local search have no SQL form; the
kept rows of the stages are tested against plain Python in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate as dec
from ledgerlens.llm import jaccard_join, language_id, line_dedup, packing
from ledgerlens.llm.common import write_table
from ledgerlens.llm.queries import TOKENIZER
from ledgerlens.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language must hold at least this share of the likelihoods.
MIN_SCORE = 0.5
#: Later copies of a line of so many words go without a repeated neighbour.
LONG_LINE_WORDS = 50
#: Near copies: words of a shingle, and the least Jaccard similarity in percent.
ALIKE_WORDS, ALIKE_PERCENT = 5, 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = language_id.identify(docs.select(*COLUMNS), language_id.train(docs))
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(docs.select(*COLUMNS), long_words=LONG_LINE_WORDS)
    left = out.filter((F.col("n_removed") == 0) | (F.length("text") > 0))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def row_key() -> list[Column]:
    """128 bits of all columns; only rows that are equal in all of them share it."""
    parts = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(i), *parts).alias(f"k{i}") for i in (0, 1)]


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keys = ["k0", "k1"]
    keyed = docs.select(*COLUMNS, *row_key())
    found = write_table(jaccard_join.join(keyed, percent=ALIKE_PERCENT, size=ALIKE_WORDS, keys=("k0", "k1")), "alike").filter("root IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *keys)
    first = found.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first")
    gone = found.join(first, "root").filter("k0 <> first.k0 OR k1 <> first.k1").select(*keys).distinct()
    again = found.groupBy(*keys).count().filter("count > 1").select(*keys)
    # texts whose key hash is not touched do not move (at most FLAG_BUCKETS rows are broadcast)
    flag = F.pmod("k0", F.lit(line_dedup.FLAG_BUCKETS))
    flags = F.broadcast(gone.unionByName(again).select(flag.alias("_flag")).distinct())
    # rows without words are alike to nothing, also to their equals
    keyed = keyed.withColumn("_flag", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), flag).otherwise(F.lit(-1)))
    # equal rows become one before they are sent
    one = keyed.join(flags, "_flag", "left_semi").dropDuplicates(keys).join(gone, keys, "left_anti").select(*COLUMNS)
    return keyed.join(flags, "_flag", "left_anti").select(*COLUMNS).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dec.decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))
    return out.filter(~F.col("contaminated")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [("language_id", identify), ("line_dedup", drop_repeated_lines), ("jaccard_join", keep_one_of_alike),
          ("decontaminate", drop_contaminated), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
