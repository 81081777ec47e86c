"""Operators over whole corpora: routing each document to its reducer, and the upkeep report of a prose corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terseflow.functions import classify
from terseflow.functions.metrics import with_stats
from terseflow.operators import code, dedup, prose, schema, validate
from terseflow.semantics import extension

LINES = 200
CODE_EXT = (".go", *code.SCRIPT_EXT)
CONFIG_EXT = tuple(f".{x}" for x in "json yaml yml".split())


def line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")) + 1


def route(path: Column, text: Column, line_threshold: int = LINES) -> Column:
    """below_threshold, unsupported_reducer, prose, code or config; null text is below."""
    kind, ext = classify.classification(path, text), extension(path)
    fit = F.when(kind == "natural_language", "prose").when((kind == "code") & ext.isin(*CODE_EXT), "code").when((kind == "config") & ext.isin(*CONFIG_EXT), "config")
    return F.when(F.coalesce(line_count(text), F.lit(0)) < line_threshold, "below_threshold").otherwise(F.coalesce(fit, F.lit("unsupported_reducer")))


def smart_read(docs: DataFrame, path_col: str = "path", text_col: str = "content", line_threshold: int = LINES) -> DataFrame:
    """Adds output, changed, findings, error and stats; every reducer's UDF sees the text of its own route alone, null else. No shuffle."""
    path, text = F.col(path_col), F.col(text_col)
    bad = classify.is_sensitive_path(path)
    staged = docs.withColumn("__tf_kind", classify.classification(path, F.when(~bad, text))).withColumn("__tf_route", F.when(~bad, route(path, text, line_threshold)))
    where = F.col("__tf_route")
    staged = staged.withColumn("__tf_code", code.reduced_files(path, F.when(where == "code", text))).withColumn("__tf_conf", schema.minified(path, F.when(where == "config", text))).withColumn("__tf_prose", prose.compressed(F.when(where == "prose", text)))
    reduced = F.when(where == "prose", F.col("__tf_prose")).when(where == "code", F.col("__tf_code.output")).when(where == "config", F.col("__tf_conf.output"))
    staged = staged.withColumn("__tf_out", reduced)
    kind = F.concat(F.lit("classification="), F.col("__tf_kind"))
    passed = F.when(where.isin("prose", "code", "config"), "reduction_failed").otherwise(where)
    findings = (
        F.when(where == "below_threshold", F.array(F.lit("passthrough=below_threshold")))
        .when(F.col("__tf_out").isNull(), F.array(kind, F.concat(F.lit("passthrough="), passed)))
        .otherwise(F.concat(F.when(where == "code", F.col("__tf_code.findings")).otherwise(F.array().cast("array<string>")), F.array(kind)))
    )
    done = staged.withColumn("error", F.when(bad, F.format_string('refusing sensitive path "%s"', path)))
    done = done.withColumn("output", F.when(~bad, F.coalesce("__tf_out", text_col))).withColumn("findings", F.when(~bad, findings))
    done = done.withColumn("changed", F.coalesce(F.col("output") != text, F.lit(False)))
    return with_stats(done, text_col, "output").drop("__tf_kind", "__tf_route", "__tf_code", "__tf_conf", "__tf_prose", "__tf_out")


def maintain(docs: DataFrame, path_col: str = "path", text_col: str = "content", rewrite: bool = False, threshold: float = dedup.THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, findings, summary). With `rewrite` duplicates are sought in the compressed texts."""
    path, text = F.col(path_col), F.col(text_col)
    seen = docs.where(~classify.is_sensitive_path(path)).select(path.alias("path"), text.alias("content"))
    kinds = seen.withColumn("kind", classify.classification(F.col("path"), F.col("content")))
    is_prose = F.col("kind") == "natural_language"
    done = kinds.withColumn("candidate", prose.compressed(F.when(is_prose, F.col("content"))))
    done = done.withColumn("report", validate.report(F.when(is_prose, F.col("content")), F.col("candidate")))
    ok = is_prose & F.col("report.valid")
    done = with_stats(done.withColumn("output", F.when(ok, F.col("candidate"))), "content", "output").withColumn("changed", ok & F.coalesce(F.col("output") != F.col("content"), F.lit(False)))

    def delta(name: str) -> Column:
        return F.col(f"stats.input{name}") - F.col(f"stats.output{name}")

    said = (
        F.when(~is_prose, F.array(F.format_string("skip %s: classification=%s", "path", "kind")))
        .when(~ok, F.array(F.format_string("skip %s: validation failed: %s", F.col("path"), validate.error_text(F.col("report")))))
        .otherwise(
            F.concat(
                F.when(F.col("changed"), F.array(F.format_string("compressed %s: saved" " %d bytes," " %d approx tokens", F.col("path"), delta("Bytes"), delta("ApproxTokens")))).otherwise(F.array().cast("array<string>")),
                F.transform("report.warnings", lambda w: F.concat(F.col("path"), F.lit(": "), w)),
            )
        )
    )
    per_file = done.select(F.lit(1).alias("part"), F.col("path").alias("key"), F.posexplode(said).alias("pos", "finding"))
    corpus = done.where(is_prose).select("path", (F.coalesce("output", "content") if rewrite else F.col("content")).alias("content"))
    found = dedup.sentences(corpus, "path", "content")
    places = F.array_join("locations", ", ")
    exact = dedup.exact_duplicates(found).select(F.lit(2).alias("part"), F.col("sentence").alias("key"), F.lit(0).alias("pos"), F.format_string('exact duplicate: "%s" in [%s]', F.col("sentence"), places).alias("finding"))
    several = F.broadcast(corpus.agg(F.count("*").alias("files")).where("files > 1"))
    # what a pair of sentences says is spelled once for all its occurrences
    pairs = dedup.near_pairs(found, threshold).join(several, how="left_semi")
    worded = pairs.select("left", "right", F.format_string("%.6f", 1 - F.col("similarity")).alias("rank"), F.format_string('near duplicate (%.0f%%): "', F.col("similarity") * 100).alias("head"))
    near = dedup.occurrence_pairs(found, worded).select(
        F.lit(3).alias("part"), F.concat("rank", "sentence").alias("key"), F.lit(0).alias("pos"), F.concat("head", "sentence", F.lit('" in ['), "first", F.lit(", "), "second", F.lit("]")).alias("finding")
    )
    findings = per_file.unionByName(exact.join(several, how="left_semi")).unionByName(near)
    totals = done.agg(
        F.count("*").alias("scanned"), F.count_if("changed").alias("changed"),
        F.coalesce(F.sum(F.when(ok, delta("Bytes"))), F.lit(0)).cast("long").alias("bytes_saved"), F.coalesce(F.sum(F.when(ok, delta("ApproxTokens"))), F.lit(0)).cast("long").alias("tokens_saved"),
    )
    text_of = F.format_string("maintain: %d files scanned," " %d changed, saved" " %d bytes / %d approx tokens", "scanned", "changed", "bytes_saved", "tokens_saved")
    return done.drop("candidate"), findings, totals.withColumn("summary", F.when(F.col("scanned") == 0, "no eligible files found").otherwise(text_of))
