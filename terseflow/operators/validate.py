"""Whether a rewritten document keeps the structure of its original."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terseflow.operators import zones
from terseflow.semantics import PATH, URL

_URL, _PATH = re.compile(URL), re.compile(PATH)
_BULLET = re.compile(r"^[\t\n\f\r ]*[-*+][\t\n\f\r ]+", re.M)
DRIFT = 0.15

REPORT = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("warnings", T.ArrayType(T.StringType()))])


def drifts(before: int, after: int) -> bool:
    return before > 0 and abs(before - after) / before > DRIFT


#: What may differ, in the order of reports; the number of errors among it.
KINDS = ("heading mismatch", "code block mismatch", "url mismatch", "path mismatch", "bullet count drift")
ERRORS = 3


def differences(original: str, candidate: str) -> int:
    """A bit for each of KINDS that holds. Texts without what starts a kind are not searched for it."""
    if original == candidate:
        return 0
    (headings, fences), (new_headings, new_fences) = zones.structure(original), zones.structure(candidate)
    found = (headings != new_headings) | (fences != new_fences) << 1
    if "http" in original or "http" in candidate:
        found |= (_URL.findall(original) != _URL.findall(candidate)) << 2
    if "/" in original or "/" in candidate:
        found |= (_PATH.findall(original) != _PATH.findall(candidate)) << 3
    return found | drifts(len(_BULLET.findall(original)), len(_BULLET.findall(candidate))) << 4


def named(found: int) -> tuple[list[str], list[str]]:
    """(errors, warnings) of differences(), in fixed order."""
    names = [(i, k) for i, k in enumerate(KINDS) if found >> i & 1]
    return [k for i, k in names if i < ERRORS], [k for i, k in names if i >= ERRORS]


def compare(original: str, candidate: str) -> tuple[list[str], list[str]]:
    """(errors, warnings), in fixed order."""
    return named(differences(original, candidate))


@F.pandas_udf(T.IntegerType())
def _differences(original: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([differences(a or "", b or "") for a, b in zip(original, candidate)], dtype="int32")


def report(original: Column, candidate: Column) -> Column:
    """A number comes back from Python, and the report is looked up by it."""

    def texts(names: list[str]) -> Column:
        return F.array(*map(F.lit, names)).cast("array<string>")

    reports = [named(i) for i in range(1 << len(KINDS))]
    table = F.array(*[F.struct(F.lit(not e).alias("valid"), texts(e).alias("errors"), texts(w).alias("warnings")) for e, w in reports])
    return F.get(table, _differences(original, candidate)).cast(REPORT)


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def paths(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATH), F.lit(1))


def bullets(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?dm)^[\t\n\f\r ]*[-*+][\t\n\f\r ]+"))


def bullet_drift(original: Column, candidate: Column) -> Column:
    before, after = bullets(original), bullets(candidate)
    return (before > 0) & (F.abs(before - after) / F.when(before > 0, before) > F.lit(DRIFT))


def error_text(report_col: Column) -> Column:
    """What a failed validation says; null for a valid one."""
    return F.when(~report_col["valid"], F.concat(F.lit("validation failed: "), F.array_join(report_col["errors"], ", ")))


def validate(originals: DataFrame, candidates: DataFrame, on: str = "path", text_col: str = "content") -> DataFrame:
    """Pairs of documents by `on` with their report."""
    left = originals.select(on, F.col(text_col).alias("original"))
    right = candidates.select(on, F.col(text_col).alias("candidate"))
    return left.join(right, on).withColumn("report", report(F.col("original"), F.col("candidate")))
