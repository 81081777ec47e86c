"""Transcript compaction: repeated reads of a file, blank and repeated lines, long tool payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MESSAGE = "struct<role:string,content:string,toolName:string,filePath:string,timestamp:string>"
HEAD = TAIL = 20


def unescaped(content: Column) -> Column:
    """A backslash and an n become a newline."""
    return F.replace(content, F.lit("\\n"), F.lit("\n"))


def filled_lines(content: Column) -> Column:
    return F.filter(F.split(content, "\n"), lambda x: x != "")


def collapsed(content: Column) -> Column:
    """Blank lines go; if all others are one line repeated, it is said once with its count."""
    kept = filled_lines(content)
    same = (F.size(kept) > 1) & (F.size(F.array_distinct(kept)) == 1)
    return F.when(F.size(kept) == 0, content).when(same, F.concat(F.element_at(kept, 1), F.lit(" x"), F.size(kept).cast("string"))).otherwise(F.array_join(kept, "\n"))


def trimmed(content: Column, tool: Column) -> Column:
    """Of a tool's payload the first and last lines, with a note between them."""
    kept = filled_lines(content)
    note = F.concat(F.lit("... "), (F.size(kept) - (HEAD + TAIL)).cast("string"), F.lit(" lines omitted ..."))
    short = F.concat(F.slice(kept, 1, HEAD), F.array(note), F.slice(kept, -TAIL, TAIL))
    return F.when(tool == "", content).when(F.size(kept) > HEAD + TAIL + 1, F.array_join(short, "\n")).otherwise(F.array_join(kept, "\n"))


def keep_last_reads(messages: DataFrame, conv_col: str, idx_col: str) -> DataFrame:
    """Of messages with the same file, tool and role in a conversation the last; those without a file all stay."""
    same = Window.partitionBy(conv_col, "filePath", "toolName", "role", F.when(F.col("filePath") == "", F.col(idx_col))).orderBy(F.desc(idx_col))
    return messages.withColumn("__tf_n", F.row_number().over(same)).where((F.col("filePath") == "") | (F.col("__tf_n") == 1)).drop("__tf_n")


def compact_history(messages: DataFrame, conv_col: str, idx_col: str) -> DataFrame:
    """Messages (role, content, toolName, filePath; null is empty) after the three passes."""
    plain = messages.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "content", "toolName", "filePath")})
    kept = keep_last_reads(plain, conv_col, idx_col)
    return kept.withColumn("content", trimmed(collapsed(unescaped(F.col("content"))), F.col("toolName")))


def compact_history_json(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, output, error): transcripts as JSON arrays in and out, optional fields left out where empty; malformed ones have an error."""
    parsed = docs.select(id_col, F.from_json(F.col(text_col), f"array<{MESSAGE}>").alias("m"), F.is_variant_null(F.try_parse_json(text_col)).alias("bad"), F.schema_of_variant(F.try_parse_json(text_col)).alias("kind"))
    good = parsed.where(F.col("m").isNotNull() & F.startswith("kind", F.lit("ARRAY")))
    rows = good.select(id_col, F.size("m").alias("n"), F.posexplode_outer("m").alias("idx", "msg")).select(id_col, "n", "idx", "msg.*")
    kept = compact_history(rows.where("n > 0"), id_col, "idx")
    fields = [F.col("role"), F.col("content"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("toolName", "filePath", "timestamp")]]
    packed = kept.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", F.struct(*fields).alias("m")))).alias("all"))
    out = packed.select(id_col, F.to_json(F.transform("all", lambda x: x["m"]), {"ignoreNullFields": "true"}).alias("output"))
    empty = good.where(F.size("m") == 0).select(id_col, F.lit("[]").alias("output"))
    return docs.select(id_col).join(out.unionByName(empty), id_col, "left").withColumn("error", F.when(F.col("output").isNull(), "malformed transcript"))
