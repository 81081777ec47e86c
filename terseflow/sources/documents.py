"""Documents in and out: folders of files as a corpus table, versioned writes with a backup, JSON lines of runs."""

from __future__ import annotations

import os
import shutil

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terseflow.functions.classify import SENSITIVE_DIRS, SENSITIVE_NAMES, is_sensitive_path

SIZE_FIELDS = [T.StructField(n, T.LongType()) for n in ("inputBytes", "outputBytes", "inputWords", "outputWords", "inputApproxTokens", "outputApproxTokens")]
STATS = T.StructType(SIZE_FIELDS)
RESULT = T.StructType(
    [
        T.StructField("command", T.StringType()),
        T.StructField("changed", T.BooleanType()),
        T.StructField("stats", STATS),
        T.StructField("producedOutput", T.BooleanType()),
        T.StructField("findings", T.ArrayType(T.StringType())),
        T.StructField("output", T.StringType()),
    ]
)
RUN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("command", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("startedAt", T.TimestampType()),
        T.StructField("finishedAt", T.TimestampType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("changed", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("stats", STATS),
    ]
)
EVENT = T.StructType([T.StructField("kind", T.StringType()), *RUN.fields[:-1], T.StructField("payloadStatus", T.StringType()), T.StructField("input", T.StringType()), T.StructField("result", RESULT), T.StructField("resultSummary", T.StringType())])


def read_corpus(spark: SparkSession, root: str, in_order: bool = False) -> DataFrame:
    """(path, content) of every file below `root`, one row a file, without sensitive paths, be they so by name or by where their links lead.

    Paths are those of the listing. `in_order` sorts by path, as a walk of the folders would; that is a shuffle.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    is_local = F.startswith("path", F.lit("file:"))
    local = F.regexp_replace("path", "^file:/*", "/")
    linked = F.coalesce(_leads_to_sensitive(F.when(is_local, local)), F.lit(False))  # other file systems have no links
    kept = files.where(~is_sensitive_path(local) & ~linked).select(local.alias("path"), F.decode("content", "utf-8").alias("content"))
    return kept.orderBy("path") if in_order else kept


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("content"))


def is_sensitive_resolved(path: str) -> bool:
    """The driver's check at listing time: symbolic links are followed, broken ones count as sensitive."""

    def lexical(p: str) -> bool:
        parts = os.path.normpath(p).split(os.sep)
        return parts[-1] in SENSITIVE_NAMES or not set(parts).isdisjoint(SENSITIVE_DIRS)

    if lexical(path):
        return True
    if os.path.islink(path) and not os.path.exists(path):
        return True
    return os.path.exists(path) and lexical(os.path.realpath(path))


@F.pandas_udf(T.BooleanType())
def _leads_to_sensitive(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: None if p is None else is_sensitive_resolved(p)).astype("boolean")


def write_with_backup(path: str, original: str, output: str) -> None:
    """The new text under `path`, the old one under its .bak; a reader sees one or the other. A failure leaves the old text."""
    backup, staged = f"{path}.bak", f"{path}.tmp"
    with open(backup, "w", encoding="utf-8") as file:
        file.write(original)
    try:
        with open(staged, "w", encoding="utf-8") as file:
            file.write(output)
        shutil.copymode(path, staged)
        os.replace(staged, path)
    except OSError:
        if os.path.exists(staged):
            os.remove(staged)
        os.replace(backup, path)
        raise


def write_versioned(docs: DataFrame, target: str, version: str) -> str:
    """A corpus as a new version folder next to the old ones, which are the backup."""
    folder = f"{target}/version={version}"
    docs.write.mode("error").parquet(folder)
    return folder


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Finished runs from JSON lines; one bad line fails the load."""
    return spark.read.schema(RUN).option("mode", "FAILFAST").json(path)


def read_recent(spark: SparkSession, path: str) -> DataFrame:
    """Runs from a file that holds one JSON array."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").option("multiLine", True).json(path)


def write_history(runs: DataFrame, path: str, mode: str = "append") -> None:
    runs.write.mode(mode).json(path, ignoreNullFields=True)


def record_diagnostic(spark: SparkSession, path: str, message: str) -> None:
    spark.range(1).select(F.current_timestamp().alias("recordedAt"), F.lit(message).alias("message")).coalesce(1).write.mode("append").json(path)


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Run events as they arrive as JSON files; back-pressure is files_per_trigger."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def result_struct(command: str, changed: Column, stats: Column, produced: Column, findings: Column, output: Column) -> Column:
    return F.struct(F.lit(command).alias("command"), changed.alias("changed"), stats.alias("stats"), produced.alias("producedOutput"), F.nullif(findings, F.array().cast("array<string>")).alias("findings"), F.nullif(output, F.lit("")).alias("output"))


def result_json(result: Column) -> Column:
    """One JSON line; empty fields are left out, and <, > and & are escaped."""
    line = F.to_json(result)
    for sign in "<>&":
        line = F.replace(line, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return line


def result_text(result: Column) -> Column:
    """The output or, without one, what changed; then the findings."""
    head = F.coalesce(F.nullif(result["output"], F.lit("")), F.concat(result["command"], F.lit(" changed="), result["changed"].cast("string"), F.lit("\n")))
    tail = F.when(F.size(result["findings"]) > 0, F.concat(F.lit("\nFindings:\n"), F.array_join(F.transform(result["findings"], lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), "")))
    return F.concat(head, F.coalesce(tail, F.lit("")))
