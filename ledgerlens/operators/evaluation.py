"""Accuracy metrics over labelled sets (A20-A24, J9) and the evaluation run
(L9). Every metric is an aggregation over a results table; ``rollup`` gives
the overall row and the per-class rows in one pass. Empty inputs give zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab as V

_OUT = "suite string, slice string, value double, hits long, total long"


def _rate(hits: F.Column, total: F.Column) -> F.Column:
    return F.coalesce(F.try_divide(hits.cast("double"), total.cast("double")), F.lit(0.0))


def class_accuracy(results: DataFrame, expected: str, actual: str, suite: str) -> DataFrame:
    """Overall accuracy (slice 'all') and accuracy per expected class."""
    ok = (F.col(expected) == F.col(actual)).cast("long")
    g = (results.rollup(expected)
         .agg(F.coalesce(F.sum(ok), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("total"), F.grouping_id().alias("_all")))
    part = g.select((F.col("_all") == 1).alias("_all"), F.when(F.col("_all") == 1, F.lit("all"))
                    .otherwise(F.coalesce(F.col(expected).cast("string"), F.lit("unlabelled"))).alias("slice"), "hits", "total")
    # rollup over an empty input yields no grand-total row: a zero row is added to it.
    # A class that is itself named "all" stays a row of its own
    zero = results.sparkSession.createDataFrame([(True, "all", 0, 0)], "_all boolean, slice string, hits long, total long")
    both = part.unionByName(zero).groupBy("_all", "slice").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))
    return both.select(F.lit(suite).alias("suite"), "slice", _rate(F.col("hits"), F.col("total")).alias("value"), "hits", "total")


def route_accuracy(results: DataFrame) -> DataFrame:
    """results(expected_route, actual_route)."""
    return class_accuracy(results, "expected_route", "actual_route", "router")


def verdict_accuracy(results: DataFrame) -> DataFrame:
    """results(expected_verdict, actual_verdict)."""
    return class_accuracy(results, "expected_verdict", "actual_verdict", "claims")


def verdict_f1(results: DataFrame, labels=("Supported", "Contradicted", "Unverifiable")) -> DataFrame:
    """A23 (promised by the reference's docs, computed here): precision,
    recall and F1 per verdict from the confusion counts of one aggregation."""
    aggs = []
    for i, v in enumerate(labels):
        e, a = F.col("expected_verdict") == v, F.col("actual_verdict") == v
        aggs += [F.count_if(e & a).alias(f"tp{i}"), F.count_if(~e & a).alias(f"fp{i}"),
                 F.count_if(e & ~a).alias(f"fn{i}")]
    one = results.agg(*aggs)
    rows = []
    for i, v in enumerate(labels):
        tp, fp, fn = F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")
        p = _rate(tp, tp + fp)
        r = _rate(tp, tp + fn)
        f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
        rows.append(F.struct(F.lit(v).alias("verdict"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                             p.alias("precision"), r.alias("recall"), f1.alias("f1")))
    return one.select(F.inline(F.array(*rows)))


def hit_at_k(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """A question is a hit when any expected keyword (lower-case,
    substring) occurs in its retrieved texts joined by spaces.

    ``hits``: (question_id, rank, text); ``expected``: (question_id, keywords array).
    """
    joined = (hits.groupBy("question_id")
              .agg(F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))),
                                                    lambda h: h["text"]), " ")).alias("_all")))
    per_q = (expected.join(joined, "question_id", "left")
             .select("question_id", F.coalesce(F.exists("keywords", lambda k: F.coalesce(F.col("_all"), F.lit(""))
                                                         .contains(F.lower(k))), F.lit(False)).alias("hit")))
    return per_q.agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total")).select(
        F.lit("retrieval").alias("suite"), F.lit("all").alias("slice"),
        _rate(F.col("hits"), F.col("total")).alias("value"),
        F.col("hits").cast("long").alias("hits"), F.col("total").cast("long").alias("total"))


def citation_rate(answers: DataFrame, text_col: str = "answer") -> DataFrame:
    """Share of answers that cite a page as "(page N)"."""
    cited = F.coalesce(F.col(text_col), F.lit("")).rlike(V.CITATION_PATTERN)
    return answers.agg(F.count_if(cited).alias("hits"), F.count(F.lit(1)).alias("total")).select(
        F.lit("citation").alias("suite"), F.lit("all").alias("slice"),
        _rate(F.col("hits"), F.col("total")).alias("value"),
        F.col("hits").cast("long").alias("hits"), F.col("total").cast("long").alias("total"))


def evaluation_report(*metric_tables: DataFrame) -> DataFrame:
    """One table (suite, slice, value, hits, total) from the metric tables."""
    out = metric_tables[0]
    for t in metric_tables[1:]:
        out = out.unionByName(t)
    return out


def expected_vs_actual(expected: DataFrame, actual: DataFrame, key: str = "id") -> DataFrame:
    """Labelled cases joined to the results by case id (cases without a
    result are kept with a null actual value)."""
    return expected.join(actual, key, "left")
