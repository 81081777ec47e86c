"""Prose compression: the full cascade on documents (Arrow UDF) and single phases as Catalyst expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terseflow.functions import classify
from terseflow.functions.metrics import with_stats
from terseflow.operators import validate, zones
from terseflow.plans.rules import PHASES, rewrite, tidy


def compress_text(text: str) -> str:
    return "".join(tidy(rewrite(z)) if kind == "prose" else z for kind, z in zones.split(text))


@F.pandas_udf(T.StringType())
def _compress(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else compress_text(t))


def compressed(text: Column) -> Column:
    return _compress(text)


def phase_by_lines(frame: DataFrame, text_col: str, phase: str) -> DataFrame:
    """One phase on plain prose, without Python: a narrow projection for each rule, so that the plan stays linear in the number of rules. A rule is tried only where its literal occurs."""
    for rule in PHASES[phase]:
        x = F.col(text_col)
        frame = frame.withColumn(text_col, F.when(F.contains(x, F.lit(rule.literal)), F.regexp_replace(x, rule.java, rule.replacement)).otherwise(x))
    return frame


def tidied(text: Column) -> Column:
    """White space after the rules."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, "[ \t]{2,}", " "), r"[\t\f\r ]+([.,;:!?])", "$1"), F.lit("ensure to"), F.lit("ensure"))


def compress(docs: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """Adds output, changed, findings, error and stats. Nothing raises: sensitive, unfit and invalid documents have an error and no output."""
    text, path = F.col(text_col), F.col(path_col)
    kind = classify.classification(path, text)
    staged = docs.withColumn("__tf_kind", kind).withColumn("__tf_bad", classify.is_sensitive_path(path))
    fit = (F.col("__tf_kind") == "natural_language") & ~F.col("__tf_bad") & text.isNotNull()
    staged = staged.withColumn("__tf_out", compressed(F.when(fit, text))).withColumn("__tf_rep", validate.report(F.when(fit, text), F.col("__tf_out")))
    error = (
        F.when(F.col("__tf_bad"), F.format_string('refusing sensitive path "%s"', path))
        .when(text.isNull(), F.lit("no content"))
        .when(F.col("__tf_kind") != "natural_language", F.concat(F.lit("compress requires natural language, got "), F.col("__tf_kind")))
        .otherwise(validate.error_text(F.col("__tf_rep")))
    )
    done = staged.withColumn("error", error)
    ok = F.col("error").isNull()
    done = done.withColumn("output", F.when(ok, F.col("__tf_out"))).withColumn("findings", F.when(ok, F.col("__tf_rep.warnings")))
    done = done.withColumn("changed", F.coalesce(F.col("output") != text, F.lit(False)))
    return with_stats(done, text_col, "output").drop("__tf_kind", "__tf_bad", "__tf_out", "__tf_rep")
