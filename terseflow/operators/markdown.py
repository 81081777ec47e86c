"""Markdown cleanup: blank runs, bullets and table rows, outside fences.

A line's state depends only on lines before it in the same document, so the document is one array and the cleanup one
expression over it: no explode, no shuffle. optimize_lines() is the same as windows over lines that are rows already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terseflow.semantics import TICK, lines_of, trim_space


def _right_trimmed(line: Column) -> Column:
    return F.regexp_replace(line, "[ \t]+$", "")


def is_fence_mark(line: Column) -> Column:
    start = F.substring(trim_space(line), 1, 3)
    return start.isin(TICK * 3, "~~~")


def compact_row(row: Column) -> Column:
    """A table row with its cells trimmed."""
    return F.array_join(F.transform(F.split(row, r"\|"), lambda c: trim_space(c)), "|")


def cleaned(line: Column) -> Column:
    """A line outside fences."""
    flat = trim_space(line)
    bullet = F.substring(flat, 1, 2).isin("* ", "+ ")
    row = F.startswith(flat, F.lit("|")) & F.endswith(flat, F.lit("|"))
    return F.when(row, compact_row(flat)).when(bullet, F.concat(F.lit("- "), trim_space(F.substr(flat, F.lit(3))))).otherwise(_right_trimmed(line))


def optimized(text: Column) -> Column:
    """The whole cleanup as one expression: a fold over lines that carries (kept lines, in a fence, after a blank)."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("fence"), F.lit(False).alias("blank"))

    def step(s: Column, line: Column) -> Column:
        mark, empty = is_fence_mark(line), trim_space(line) == ""
        keep = (
            F.when(mark, F.array(_right_trimmed(line)))
            .when(s["fence"], F.array(line))
            .when(empty & s["blank"], F.array().cast("array<string>"))
            .when(empty, F.array(F.lit("")))
            .otherwise(F.array(cleaned(line)))
        )
        return F.struct(F.concat(s["out"], keep).alias("out"), F.when(mark, ~s["fence"]).otherwise(s["fence"]).alias("fence"), (~mark & ~s["fence"] & empty).alias("blank"))

    return F.aggregate(lines_of(text), start, step, lambda s: F.array_join(s["out"], "\n"))


def optimize_lines(lines: DataFrame, doc_col: str, pos_col: str, line_col: str) -> DataFrame:
    """The same over one row a line, partitioned by document once: the lines that stay, cleaned."""
    by_doc = Window.partitionBy(doc_col).orderBy(pos_col)
    mark, empty = is_fence_mark(F.col(line_col)), trim_space(F.col(line_col)) == ""
    marks = F.sum(F.when(mark, 1).otherwise(0)).over(by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    staged = lines.withColumn("__tf_mark", mark).withColumn("__tf_in", (marks % 2 == 1) & ~mark).withColumn("__tf_blank", ~mark & ~F.col("__tf_in") & empty)
    staged = staged.withColumn("__tf_again", F.col("__tf_blank") & F.coalesce(F.lag("__tf_blank").over(by_doc), F.lit(False)))
    line = F.when(F.col("__tf_mark"), _right_trimmed(F.col(line_col))).when(F.col("__tf_in"), F.col(line_col)).when(F.col("__tf_blank"), F.lit("")).otherwise(cleaned(F.col(line_col)))
    return staged.where(~F.col("__tf_again")).withColumn(line_col, line).drop("__tf_mark", "__tf_in", "__tf_blank", "__tf_again")


def optimize_markdown(docs: DataFrame, id_col: str, text_col: str, output_col: str = "output") -> DataFrame:
    """Adds the cleaned text. Documents are exploded into lines and put together again; null text stays null, equal ids are kept apart."""
    keyed = docs.withColumn("__tf_row", F.struct(F.col(id_col), F.monotonically_increasing_id()))
    lines = keyed.select("__tf_row", F.posexplode(lines_of(F.col(text_col))).alias("__tf_pos", "__tf_line"))
    kept = optimize_lines(lines, "__tf_row", "__tf_pos", "__tf_line")
    joined = kept.groupBy("__tf_row").agg(F.array_sort(F.collect_list(F.struct("__tf_pos", "__tf_line"))).alias("__tf_all"))
    text = F.array_join(F.transform("__tf_all", lambda x: x["__tf_line"]), "\n")
    return keyed.join(joined.withColumn(output_col, text).drop("__tf_all"), "__tf_row", "left").drop("__tf_row")
