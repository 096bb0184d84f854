"""Distributed running offsets in a total order, without a global window.

A window with no ``partitionBy`` pulls every row into one task. Instead:

1. range-partition by the order key (balanced by sampling, so a hot key is
   split across partitions like any other range);
2. running sum inside each range partition (a window per partition id);
3. per-partition totals -> exclusive prefix over at most ``num_partitions``
   rows, broadcast back (its size is bounded by the partition count, not by
   the data).

The range-partitioned key table is checkpointed (reliable checkpoint into
``spark.checkpoint.dir``) before it feeds both branches: range bounds come
from sampling, and two evaluations could otherwise assign different partition
ids. Callers pass a narrow frame (keys + weight), never wide text.

Used for sequential chunk ids (T4), series positions (T7) and report lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _partitions_for(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def with_running_offset(df: DataFrame, order_cols: list[str], weight: str | None = None,
                        out: str = "_offset", num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``weight`` (1 per row if None) over all rows strictly
    before this row in ``order_cols`` order. ``order_cols`` must be unique."""
    w_col = F.col(weight) if weight else F.lit(1)
    n = _partitions_for(df, num_partitions)
    ranged = cut_lineage(df.withColumn("_w", w_col.cast("long"))
                         .repartitionByRange(n, *order_cols)
                         .withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn(
        "_local", F.sum("_w").over(Window.partitionBy("_part").orderBy(*order_cols)
                                   .rowsBetween(Window.unboundedPreceding, -1)))
    local = local.withColumn("_local", F.coalesce("_local", F.lit(0)))
    totals = ranged.groupBy("_part").agg(F.sum("_w").alias("_tot"))
    # at most n rows: a single-partition window here is bounded by design
    base = totals.withColumn(
        "_base",
        F.coalesce(F.sum("_tot").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(F.broadcast(base.select("_part", "_base")), "_part")
            .withColumn(out, F.col("_base") + F.col("_local"))
            .drop("_part", "_w", "_local", "_base"))


def with_row_index(df: DataFrame, order_cols: list[str], out: str = "_idx",
                   num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order."""
    return with_running_offset(df, order_cols, None, out, num_partitions)
