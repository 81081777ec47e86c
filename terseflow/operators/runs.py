"""The run log: totals, trends, insights, retention and what runs are active.

A run has command, started_at, success, changed and six sizes; see SIZES. An event also has id, kind and arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SIZES = ("bytes", "words", "tokens")
STALE_SECONDS = 60
HISTORY_LIMIT, RECENT_LIMIT = 1000, 32
BAR_LEAST, BAR_FULL = 12, 100


def saved(size: str) -> Column:
    return F.col(f"in_{size}") - F.col(f"out_{size}")


def _saved_sums() -> list[Column]:
    return [F.coalesce(F.sum(saved(s)), F.lit(0)).cast("long").alias(f"{s}_saved") for s in SIZES]


def _outcomes() -> list[Column]:
    return [F.count("*").alias("runs"), F.count_if(F.col("success")).alias("successful"), F.count_if(~F.col("success")).alias("failed")]


def run_summary(runs: DataFrame) -> DataFrame:
    """One row of totals; of an empty log all 0."""
    return runs.agg(*_outcomes(), *_saved_sums())


def command_usage(runs: DataFrame) -> DataFrame:
    return runs.groupBy("command").agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), "command")


def percent(part: Column, whole: Column) -> Column:
    """Integer percent, halves up."""
    return F.floor((part * 100 + F.floor(whole / 2)) / whole).cast("long")


def command_insights(runs: DataFrame) -> DataFrame:
    rows = runs.groupBy("command").agg(*_outcomes(), *_saved_sums())
    return rows.withColumn("success_rate", percent(F.col("successful"), F.col("runs"))).orderBy(F.desc("runs"), F.desc("tokens_saved"), "command")


def utc_month(frame: DataFrame, at: str) -> Column:
    """The calendar month of an instant in UTC, whatever the session's time zone; dates and times without a zone are taken as they are."""
    instant = F.to_utc_timestamp(at, F.current_timezone()) if isinstance(frame.schema[at].dataType, T.TimestampType) else F.col(at)
    return F.date_format(instant, "yyyy-MM")


def monthly_trend(runs: DataFrame) -> DataFrame:
    """Savings by calendar month of the start, in UTC."""
    return runs.groupBy(utc_month(runs, "started_at").alias("month")).agg(*_saved_sums()).orderBy("month")


def trend_display(trend: DataFrame) -> DataFrame:
    """Bars of at least BAR_LEAST and at most BAR_FULL, and a note by sign. Trends have a row a month, so one partition will do."""
    size = F.abs("tokens_saved")
    top = F.max(size).over(Window.partitionBy(F.lit(1)))
    bar = F.when((size <= 0) | (top <= 0), 0).otherwise(F.greatest(F.lit(BAR_LEAST), F.floor(size * BAR_FULL / F.when(top > 0, top)))).cast("long")
    note = F.when(F.col("tokens_saved") > 0, "steady savings").when(F.col("tokens_saved") < 0, "negative net month").otherwise("flat month")
    return trend.withColumn("bar_width", bar).withColumn("note", note)


def strongest_month(trend: DataFrame) -> DataFrame:
    """The month of most saved tokens, the earliest of equal ones."""
    return trend.orderBy(F.desc("tokens_saved"), "month").limit(1)


def outcome_context(runs: DataFrame) -> DataFrame:
    """(place, label, value, note): success rate, most active command and strongest month; no rows without runs."""
    s = run_summary(runs).where("runs > 0")
    rate = s.select(
        F.lit(1).alias("place"), F.lit("Success rate").alias("label"), F.concat(percent(F.col("successful"), F.col("runs")).cast("string"), F.lit("%")).alias("value"),
        F.format_string("%d successful and %d failed runs", "successful", "failed").alias("note"),
    )
    top = command_insights(runs).limit(1).select(
        F.lit(2).alias("place"), F.lit("Most active command").alias("label"), F.col("command").alias("value"),
        F.format_string("%d runs, %d%% success, %d tokens saved", "runs", "success_rate", "tokens_saved").alias("note"),
    )
    month = strongest_month(monthly_trend(runs)).select(
        F.lit(3).alias("place"), F.lit("Strongest savings month").alias("label"), F.col("month").alias("value"),
        F.format_string("%d tokens and %d bytes saved", "tokens_saved", "bytes_saved").alias("note"),
    )
    return rate.unionByName(top).unionByName(month)


def keep_latest(runs: DataFrame, order: list[Column | str], limit: int = HISTORY_LIMIT) -> DataFrame:
    """The last `limit` runs. A top-k: each task keeps no more than `limit` rows."""
    return runs.orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order]).limit(limit)


def latest_events(events: DataFrame, rank_kinds: bool = False) -> DataFrame:
    """One row a run: its last event by arrival or, with `rank_kinds`, a finished or failed one before any started one."""
    order = [F.col("arrival")]
    if rank_kinds:
        order.insert(0, F.when(F.col("kind") == "started", 0).otherwise(1))
    names = [c for c in events.columns if c != "id"]
    best = events.groupBy("id").agg(F.max_by(F.struct(*names), F.struct(*order)).alias("e"))
    return best.select("id", "e.*")


def with_status(latest: DataFrame, now: Column) -> DataFrame:
    """status: the kind, or 'stale' for a run that started STALE_SECONDS before `now` or earlier and has not ended."""
    old = F.col("started_at") <= now - F.make_dt_interval(secs=F.lit(STALE_SECONDS))
    return latest.withColumn("status", F.when((F.col("kind") == "started") & old, "stale").otherwise(F.col("kind")))


def active_count(latest: DataFrame, now: Column) -> DataFrame:
    live = (F.col("kind") == "started") & (F.col("started_at") > now - F.make_dt_interval(secs=F.lit(STALE_SECONDS)))
    return latest.agg(F.count_if(live).alias("active"))


def snapshot(latest: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """The `limit` most recently started runs, newest first; of equal starts the larger id first."""
    return latest.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def result_summary(error: Column, produced: Column, changed: Column) -> Column:
    """What a run did, in a line."""
    deltas = [saved(s) for s in SIZES]
    none = (deltas[0] == 0) & (deltas[1] == 0) & (deltas[2] == 0)
    said = F.format_string("changed=%s, saved" " %d bytes, %d words," " %d approx tokens", changed.cast("string"), *deltas)
    return F.when(F.coalesce(error, F.lit("")) != "", error).when(produced & ~changed & none, "output generated without a tracked content delta").otherwise(said)


def has_details(payload_status: Column, output: Column, error: Column) -> Column:
    return F.coalesce(payload_status.isin("observed", "redacted"), F.lit(False)) | (F.coalesce(output, F.lit("")) != "") | (F.coalesce(error, F.lit("")) != "")


def payload_status(inputs: Column, sensitive: Column, readable: Column) -> Column:
    """none without inputs, redacted if any is sensitive, unavailable if one can't be read, else observed."""
    return F.when(inputs == 0, "none").when(sensitive, "redacted").when(~readable, "unavailable").otherwise("observed")
