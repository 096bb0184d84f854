"""Records of CSV files read by many tasks, quoted line breaks included.

A line of a file may lie inside a quoted field that began far before it, so a
task that starts in the middle of a file cannot tell by itself whether its
first line starts a record. Each line is read both ways instead: does it end
inside quotes if it starts a record, and if it starts inside quotes? Most lines
settle the state whatever came before, the others keep or turn it:

1. every line gets its two answers where it is read (a split of the file);
2. the state before each line follows within its split from the last settled
   line and the turns since then; a split as a whole is such an answer pair too;
3. the pairs of a file's splits (one row a split) give the state each begins in;
4. lines that are a record alone are done; only the lines of records that span
   several are grouped by the record's first line.

A record starts where a line starts outside quotes. A quote opens a field only
as its first character, and is doubled inside; lines end in ``\\n`` or ``\\r\\n``.
Nothing is as large as a file in one task, but a record; a quote that is never
closed makes the rest of its file one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Possessive throughout: no line makes the matcher go back.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'                       # the inside of a quoted field
_FIELDS = rf'(?:(?:[^",][^,]*+)?,|"{_QUOTED}"[^,]*+,)*+'  # whole fields with their commas
_OPENS = rf'{_FIELDS}"{_QUOTED}$'                        # then one that the line does not close


def _ends_quoted(line: Column) -> tuple[Column, Column]:
    """Whether a line ends inside quotes: if it starts a record, if it starts inside quotes."""
    some = line.contains('"')
    return (some & line.rlike(f"(?s)^{_OPENS}"),
            ~some | line.rlike(f"(?s)^{_QUOTED}$") | line.rlike(f'(?s)^{_QUOTED}"[^,]*+,{_OPENS}'))


def _state(before: Window, start: Column) -> Column:
    """Whether a row starts inside quotes: the last settled state before it,
    else ``start``, turned as often as rows since then turn it."""
    last = F.last(F.when(F.col("settles"), F.struct("ends", "turned")), ignorenulls=True).over(before)
    turned = F.coalesce(F.max("turned").over(before), F.lit(0)) - F.coalesce(last["turned"], F.lit(0))
    return F.coalesce(last["ends"], start) != (turned % 2 == 1)


def _kinds(df: DataFrame, order: Window) -> DataFrame:
    """``settles`` and the state it ``ends`` in, and how many rows so far turn the state."""
    turns = (F.col("from_start") & ~F.col("from_quoted")).cast("int")
    return (df.withColumn("settles", F.col("from_start") == F.col("from_quoted")).withColumn("ends", F.col("from_start"))
            .withColumn("turned", F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0))))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, record, first) of every record that is not empty: its
    text, its place (file, split, order in the split) and whether it is its
    file's first, which holds the names."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    from_start, from_quoted = _ends_quoted(F.col("line"))
    in_split = Window.partitionBy("file", "block").orderBy("at")
    lines = cut_lineage(_kinds(lines.withColumn("from_start", from_start).withColumn("from_quoted", from_quoted), in_split), "lines")

    # a split as one answer pair: the state after its last line, begun either way
    def after(start: bool) -> Column:
        settled = F.col("last")["ends"]
        turned = (F.col("turned") - F.coalesce(F.col("last")["turned"], F.lit(0))) % 2 == 1
        return F.coalesce(settled, F.lit(start)) != turned

    splits = lines.groupBy("file", "block").agg(
        F.max_by(F.struct("ends", "turned"), F.when(F.col("settles"), F.col("at"))).alias("last"),
        F.max("turned").alias("turned")).select(
        "file", "block", after(False).alias("from_start"), after(True).alias("from_quoted"))
    # one row a split
    by_file = Window.partitionBy("file").orderBy("block")
    before_split = by_file.rowsBetween(Window.unboundedPreceding, -1)
    begun = _kinds(splits, by_file).select("file", "block", _state(before_split, F.lit(False)).alias("begins"))

    before_line = in_split.rowsBetween(Window.unboundedPreceding, -1)
    placed = (lines.join(begun, ["file", "block"]).withColumn("inside", _state(before_line, F.col("begins")))
              .withColumn("open", F.when(F.col("inside"), F.col("from_quoted")).otherwise(F.col("from_start"))))
    placed = cut_lineage(placed.select("file", "block", "at", "line", "inside", "open"), "placed-lines")

    alone = placed.filter(~F.col("inside") & ~F.col("open")).select("file", "block", "at", F.col("line").alias("record"))
    # a line of a longer record goes to the last record start before it, maybe in an earlier split
    longer = placed.filter("inside or open")
    start_here = F.last(F.when(~F.col("inside"), F.struct("block", "at")), ignorenulls=True).over(in_split)
    latest = longer.filter("not inside").groupBy("file", "block").agg(F.max(F.struct("block", "at")).alias("start"))
    carried = (begun.select("file", "block").join(latest, ["file", "block"], "left")
               .select("file", "block", F.last("start", ignorenulls=True).over(before_split).alias("carried")))
    joined = (longer.withColumn("start", start_here).join(carried, ["file", "block"])
              .groupBy("file", F.coalesce("start", "carried").alias("start"))
              .agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts")))
    spanning = joined.select("file", "start.block", "start.at", F.array_join(F.col("parts.line"), "\n").alias("record"))
    records = alone.unionByName(spanning).withColumn("record", F.regexp_replace("record", r"\r\z", "")).filter("record <> ''")
    firsts = records.groupBy("file").agg(F.min(F.struct("block", "at")).alias("_first"))
    return records.join(firsts, "file").select("file", "block", "at", "record",
                                               (F.struct("block", "at") == F.col("_first")).alias("first"))
