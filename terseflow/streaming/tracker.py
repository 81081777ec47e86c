"""Live runs with Structured Streaming: the latest event of each run, stale runs by timeout, and recent runs as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from terseflow.operators.runs import RECENT_LIMIT, SIZES, STALE_SECONDS, saved, utc_month

TRACKED = "id string, command string, status string, started_at timestamp, arrival long, success boolean"
_STATE = "command string, status string, started_at timestamp, arrival long, success boolean"


def _rank(status: str, arrival: int) -> tuple[bool, int]:
    """An end outranks a start that comes late; else the later arrival wins."""
    return status not in ("started", "stale"), arrival


def track_runs(events: DataFrame, stale_seconds: int = STALE_SECONDS) -> DataFrame:
    """Upserts (TRACKED) for a stream of id, command, kind, started_at, arrival, success. Each run's state is one row, dropped when the run ends or is reported stale."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: tuple[Any, ...] | None = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            if known is not None:
                command, _, started, arrival, success = known
                yield pd.DataFrame([(key[0], command, "stale", started, arrival, success)], columns=["id", "command", "status", "started_at", "arrival", "success"])
            return
        for frame in frames:
            for row in frame.itertuples(index=False):
                new = (row.command, row.kind, row.started_at, int(row.arrival), bool(row.success))
                if known is None or _rank(new[1], new[3]) >= _rank(known[1], known[3]):
                    known = new
        if known is None:
            return
        if known[1] == "started":
            state.update(known)
            state.setTimeoutDuration(stale_seconds * 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *known)], columns=["id", "command", "status", "started_at", "arrival", "success"])

    return events.groupBy("id").applyInPandasWithState(update, TRACKED, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def recent_table(path: str, limit: int = RECENT_LIMIT) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the `limit` runs that started last, one row a run. Each batch writes a new version from the last, so one that runs again writes the same; versions before the last go."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before, older = f"{path}/batch={number - 1}", f"{path}/batch={number - 2}"
        before_path, older_path = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (before, older))
        files = before_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(before_path):
            batch = batch.unionByName(spark.read.schema(TRACKED).parquet(before))
        ended = F.when(F.col("status").isin("started", "stale"), 0).otherwise(1)
        one = batch.withColumn("__tf_n", F.row_number().over(Window.partitionBy("id").orderBy(ended.desc(), F.desc("arrival"), F.when(F.col("status") == "stale", 0).otherwise(1)))).where("__tf_n = 1").drop("__tf_n")
        one.orderBy(F.desc("started_at"), F.desc("id")).limit(limit).write.mode("overwrite").parquet(f"{path}/batch={number}")
        files.delete(older_path, True)

    return sink


def monthly_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """Ended runs and, where the events carry sizes, savings by calendar month (UTC) of a stream. A run's end counts once.

    By default an end may come at any time; the state then keeps the id of every ended run. With `late` ids are kept for that
    long alone: ends that come later still are lost.
    """
    ended = events.where(F.col("kind") != "started")
    ended = ended.dropDuplicates(["id"]) if late is None else ended.withWatermark("started_at", late).dropDuplicatesWithinWatermark(["id"])
    sums = [F.sum(saved(s)).alias(f"{s}_saved") for s in SIZES if {f"in_{s}", f"out_{s}"} <= set(events.columns)]
    return ended.groupBy(utc_month(ended, "started_at").alias("month")).agg(F.count("*").alias("runs"), F.count_if("success").alias("successful"), *sums)
