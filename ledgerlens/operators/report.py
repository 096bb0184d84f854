"""Insights (L7) and the executive report lines.

The report is a small table (line_no, line): its sections are aggregates
computed by the other operators, each reduced to a handful of rows before
they meet, so nothing data-sized is assembled anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import with_row_index
from .profile import categorical_columns, numeric_columns, visible_fields


def _fmt(c, d):
    return F.format_number(c, d)


def _line(section: int, sub: int, line) -> F.Column:
    return F.struct(F.lit(section).alias("section"), F.lit(sub).cast("long").alias("sub"), line.alias("line"))


def insights(table: DataFrame, chart_cat: str | None = None) -> DataFrame:
    """(ordinal, kind, text) takeaway rows of the dashboard.

    ``chart_cat`` is the first chart-suitable categorical column (P8); pass
    None when there is none.
    """
    spark = table.sparkSession
    nums, cats = numeric_columns(table), categorical_columns(table)
    fields = visible_fields(table)
    if not nums:
        return spark.createDataFrame([], "ordinal int, kind string, text string")
    c0 = nums[0]
    c1 = nums[1] if len(nums) > 1 else None
    aggs = [F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.col(f"`{c0}`")), F.lit(0)).cast("double").alias("t0"),
            F.avg(F.col(f"`{c0}`")).alias("a0"), F.max(F.col(f"`{c0}`")).cast("double").alias("x0"),
            sum((F.count(F.lit(1)) - F.count(F.col(f"`{f.name}`")) for f in fields), F.lit(0)).alias("missing")]
    if c1:
        aggs += [F.avg(F.col(f"`{c1}`")).alias("a1"), F.min(F.col(f"`{c1}`")).cast("double").alias("n1"),
                 F.max(F.col(f"`{c1}`")).cast("double").alias("x1")]
    one = table.agg(*aggs)
    rows = [F.struct(F.lit(1).alias("ordinal"), F.lit("takeaway").alias("kind"), F.concat(
        F.lit(f"{c0.title()} totals "), _fmt(F.col("t0"), 0), F.lit(" across "), _fmt(F.col("rows"), 0),
        F.lit(" records (avg "), _fmt(F.col("a0"), 1), F.lit(", peak "), _fmt(F.col("x0"), 0), F.lit(")."),
        (F.concat(F.lit(f" {c1.title()} averages "), _fmt(F.col("a1"), 1), F.lit("."))
         if (cats and c1) else F.lit(""))).alias("text")),
        F.struct(F.lit(2).alias("ordinal"), F.lit("total").alias("kind"), F.concat(
            F.lit(f"{c0.title()} totals "), _fmt(F.col("t0"), 0), F.lit(" with an average of "),
            _fmt(F.col("a0"), 1), F.lit(" per record.")).alias("text"))]
    if c1:
        rows.append(F.struct(F.lit(3).alias("ordinal"), F.lit("range").alias("kind"), F.concat(
            F.lit(f"{c1.title()} ranges from "), _fmt(F.col("n1"), 1), F.lit(" to "), _fmt(F.col("x1"), 1),
            F.lit(".")).alias("text")))
    rows.append(F.struct(F.lit(5).alias("ordinal"), F.lit("shape").alias("kind"), F.concat(
        F.lit("Dataset has "), _fmt(F.col("rows"), 0), F.lit(f" rows × {len(fields)} columns with "),
        F.when(F.col("missing") == 0, F.lit("no")).otherwise(_fmt(F.col("missing"), 0)),
        F.lit(" missing values.")).alias("text")))
    out = one.select(F.inline(F.array(*rows)))
    if chart_cat:
        g = (table.filter(F.col(f"`{chart_cat}`").isNotNull())
             .groupBy(F.col(f"`{chart_cat}`").alias("_k"))
             .agg(F.coalesce(F.sum(F.col(f"`{c0}`")), F.lit(0)).cast("double").alias("_v"))
             .orderBy(F.desc("_v"), F.asc("_k")).limit(1))
        top = g.select(F.lit(4).alias("ordinal"), F.lit("top_group").alias("kind"), F.concat(
            F.col("_k").cast("string"), F.lit(f" is the top {chart_cat} by {c0} ("), _fmt(F.col("_v"), 0),
            F.lit(").")).alias("text"))
        out = out.unionByName(top)
    return out


def report_lines(generated_on: str, corpus: DataFrame | None, table: DataFrame | None,
                 verdicts: DataFrame | None, key_metric_limit: int | None = None) -> DataFrame:
    """Markdown report as (line_no, line).

    ``corpus``: one row (pages, characters, chunks); ``table``: the metrics
    table; ``verdicts``: verification rows (claim, verdict, csv_metric,
    actual_percent) with a ``claim_id`` for ordering.
    """
    spark = next(d for d in (corpus, table, verdicts) if d is not None).sparkSession
    sections = [spark.createDataFrame(
        [(0, i, t) for i, t in enumerate(["# Executive Report", f"Generated: {generated_on}", ""])],
        "section int, sub long, line string")]
    if corpus is not None:
        sections.append(corpus.select(F.inline(F.array(
            F.struct(F.lit(1).alias("section"), F.lit(0).cast("long").alias("sub"),
                     F.lit("## Document Overview").alias("line")),
            _line(1, 1, F.concat(F.lit("- Pages: "), F.col("pages").cast("string"))),
            _line(1, 2, F.concat(F.lit("- Characters indexed: "), _fmt(F.col("characters"), 0))),
            _line(1, 3, F.concat(F.lit("- Searchable chunks: "), F.col("chunks").cast("string"))),
            _line(1, 4, F.lit(""))))))
    if table is not None:
        nums, cats = numeric_columns(table), categorical_columns(table)
        fields = visible_fields(table)
        km = nums[:key_metric_limit]
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for i, c in enumerate(km):
            x = F.col(f"`{c}`")
            aggs += [F.coalesce(F.sum(x), F.lit(0)).cast("double").alias(f"t{i}"), F.avg(x).alias(f"m{i}"),
                     F.max(x).cast("double").alias(f"x{i}")]
        one = table.agg(*aggs)
        head = ["## Dataset Summary", None, f"- Columns: {len(fields)}",
                f"- Numeric columns: {', '.join(nums)}", f"- Categorical columns: {', '.join(cats)}", "",
                "## Key Metrics", "| Column | Total | Mean | Max |", "|--------|-------|------|-----|"]
        structs = []
        for i, t in enumerate(head):
            line = F.concat(F.lit("- Rows: "), _fmt(F.col("_rows"), 0)) if t is None else F.lit(t)
            structs.append(F.struct(F.lit(2).alias("section"), F.lit(i).cast("long").alias("sub"),
                                    line.alias("line")))
        for i, c in enumerate(km):
            structs.append(_line(2, len(head) + i, F.concat(
                F.lit(f"| {c} | "), _fmt(F.col(f"t{i}"), 2), F.lit(" | "), _fmt(F.col(f"m{i}"), 2), F.lit(" | "),
                _fmt(F.col(f"x{i}"), 2), F.lit(" |"))))
        structs.append(_line(2, len(head) + len(km), F.lit("")))
        sections.append(one.select(F.inline(F.array(*structs))))
    if verdicts is not None:
        sections.append(spark.createDataFrame(
            [(3, 0, "## Claim Verification Results"), (3, 1, "| Claim | Verdict | Column | Actual Change |"),
             (3, 2, "|-------|---------|--------|---------------|")], "section int, sub long, line string"))
        pct = F.when(F.col("actual_percent").isNull(), F.lit("—")).otherwise(
            F.format_string("%+.2f%%", F.col("actual_percent")))
        sections.append(verdicts.select(
            F.lit(4).alias("section"), F.col("claim_id").cast("long").alias("sub"),
            F.concat(F.lit("| "), F.col("claim"), F.lit(" | "), F.col("verdict"), F.lit(" | "),
                     F.coalesce(F.col("csv_metric"), F.lit("—")), F.lit(" | "), pct, F.lit(" |")).alias("line")))
        sections.append(spark.createDataFrame([(5, 0, "")], "section int, sub long, line string"))
    sections.append(spark.createDataFrame(
        [(9, 0, "---"), (9, 1, "_Report generated automatically. Verify all claims independently before use._")],
        "section int, sub long, line string"))
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    # line numbers from the distributed prefix count: the claim section grows
    # with the claims, so no single-partition window here
    numbered = with_row_index(out, ["section", "sub"], "_i")
    return numbered.select((F.col("_i") + 1).alias("line_no"), "line")
