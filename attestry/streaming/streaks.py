"""Failures in a row of every source, kept up by a stream of polls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .bands import STORE
from .session import settings

OUT = "source_id string, status string, last_status string, last_ok_at timestamp, consecutive_failures long, last_error string"


class Streak(StatefulProcessor):
    """One source: its latest poll that didn't fail, the failures after it, the latest poll and the latest worded error.

    Polls may come late, up to the watermark: failures at or after it are kept each, in case a good poll comes between
    them; of those before it the number is enough, since any good poll to come is later than all of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "ok_at long, ok_id long, last_at long, last_id long, last_status string, error_at long, error_id long, error string, settled long")
        self.failures = handle.getListState("failures", "at long, id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, none = timerValues.getCurrentWatermarkInMs() * 1000, (-(1 << 62), -(1 << 62))
        ok, last, last_status, worded, error, settled = none, none, None, none, None, 0
        if self.told.exists():
            v = self.told.get()
            ok, last, last_status, worded, error, settled = (v[0], v[1]), (v[2], v[3]), v[4], (v[5], v[6]), v[7], v[8]
        open_ = {(f[0], f[1]) for f in self.failures.get()} if self.failures.exists() else set()
        best = ok
        for part in rows:
            for at, id_, status, text in zip(part["at"], part["event_id"], part["status"], part["error"], strict=True):
                poll = (int(at), int(id_))
                if poll[0] < mark:
                    continue
                if status == "error":
                    open_.add(poll)
                else:
                    best = max(best, poll)
                if poll > last:
                    last, last_status = poll, status
                if isinstance(text, str) and text and poll > worded:
                    worded, error = poll, text
        settled = 0 if best > ok else settled
        open_ = {f for f in open_ if f > best}
        old = {f for f in open_ if f[0] < mark}
        settled, open_ = settled + len(old), open_ - old
        self.told.update((*best, *last, last_status, *worded, error, settled))
        self.failures.put(sorted(open_)) if open_ else self.failures.clear()
        n = settled + len(open_)
        yield pd.DataFrame({
            "source_id": [key[0]], "status": ["ok" if n == 0 else "degraded" if n < 3 else "failing"], "last_status": [last_status],
            "last_ok_at": pd.to_datetime([best[0] if best > none else None], unit="us"), "consecutive_failures": [n], "last_error": [error],
        })

    def close(self) -> None:
        pass


def streaks(polls: DataFrame, late: str = "1 day") -> DataFrame:
    """A row for each source that a batch of polls (source_id, event_id, started_at, status, error) touches: its state now.

    After each batch the latest rows equal source_health() over all polls so far, whatever their order, but for polls more
    than ``late`` behind the latest one, which take no part. Polls at one time are ordered by event_id.
    """
    seen = polls.withWatermark("started_at", late).filter("source_id IS NOT NULL AND started_at IS NOT NULL")
    rows = seen.select("source_id", "started_at", F.unix_micros("started_at").alias("at"), F.col("event_id").cast("long").alias("event_id"), "status", "error")
    return rows.groupBy("source_id").transformWithStateInPandas(Streak(), OUT, "update", "eventtime")


def streak_stream(polls: DataFrame, store: str, checkpoint: str, late: str = "1 day") -> None:
    """Run the stream over all that is there; each batch writes its own folder below ``store``."""
    with settings(polls.sparkSession, STORE):

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

        streaks(polls, late).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def latest(spark: SparkSession, store: str) -> DataFrame:
    """Each source's state after the last batch that touched it."""
    rows = spark.read.schema(OUT + ", batch int").parquet(store)
    others = [c for c in rows.columns if c not in ("source_id", "batch")]
    return rows.groupBy("source_id").agg(F.max_by(F.struct(*others), "batch").alias("s")).select("source_id", "s.*")
