"""Content-addressed snapshots: who comes first, what is new, what was seen."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import Log
from ..storage import delete, written


def first_writers(items: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """One row per content_hash of items that the store does not hold: the earliest by (fetched_at, ord).

    Partial aggregation keeps one row per hash and task, so a hash that many items share is not gathered.
    """
    others = [c for c in items.columns if c != "content_hash"]
    first = items.groupBy("content_hash").agg(F.min_by(F.struct(*others), F.struct("fetched_at", "ord")).alias("_first")).select("content_hash", "_first.*")
    return first if store is None else first.join(store.select("content_hash"), "content_hash", "left_anti")


def sightings(items: DataFrame) -> DataFrame:
    """Every source in which a content was seen, with its first time: what first_writers leaves out."""
    return items.groupBy("content_hash", "source_id").agg(F.min("fetched_at").alias("first_seen"), F.count("*").alias("times"))


def blob_paths(items: DataFrame) -> DataFrame:
    """Add the blob's key and its path by the first two digits."""
    return items.withColumn("blob_uri", F.concat_ws("/", F.substring("content_hash", 1, 2), "content_hash"))


def write_blobs(items: DataFrame, folder: str) -> int:
    """Write contents (content_hash, content, ...) by the first two digits of their hash, each once: what the folder
    holds, and repeats within items, are left out. Returns how many were new.

    Writers may run at once: each writes its files first and then takes the next number in the folder's log. One that
    finds the number taken leaves out what the others brought meanwhile, and tries again. Files without an entry (of
    writers that lost or died) are no part of the folder; read_blobs() never sees them.
    """
    spark, log = items.sparkSession, Log(items.sparkSession, folder)
    sharded = blob_paths(items).withColumn("shard", F.substring("content_hash", 1, 2))
    others = [c for c in sharded.columns if c not in ("content_hash", "shard")]
    one = sharded.groupBy("shard", "content_hash").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_f")).select("content_hash", "_f.*", "shard")
    one = written(one, "blobs")
    while True:
        entries = log.entries()
        held = _blobs(spark, folder, entries)
        new = one if held is None else one.join(held.select("shard", "content_hash"), ["shard", "content_hash"], "left_anti")
        part = f"part=p{uuid.uuid4().hex}"
        new.write.partitionBy("shard").parquet(f"{folder}/{part}")
        n = new.count() if held is None else spark.read.schema(one.schema).parquet(f"{folder}/{part}").count()
        if n and log.commit((entries[-1]["version"] if entries else 0) + 1, {"part": part, "rows": n}):
            return n
        delete(spark, f"{folder}/{part}")
        if not n:
            return 0


def _blobs(spark: SparkSession, folder: str, entries: list[dict]) -> DataFrame | None:
    parts = [f"{folder}/{e['part']}" for e in entries]
    return spark.read.option("basePath", folder).parquet(*parts).drop("part").withColumn("shard", F.substring("content_hash", 1, 2)) if parts else None


def read_blobs(spark: SparkSession, folder: str) -> DataFrame | None:
    """What writers have committed: content_hash, blob_uri, content, ...; None before the first one."""
    return _blobs(spark, folder, Log(spark, folder).entries())


def vacuum_blobs(spark: SparkSession, folder: str, age: float = 86_400) -> list[str]:
    """Delete files that no writer has committed and that are at least ``age`` seconds old."""
    return Log(spark, folder).vacuum(lambda e: e["part"], "part=", age)


def watermarks(events: DataFrame) -> DataFrame:
    """Per source the start of its latest poll that did not fail."""
    return events.filter("status <> 'error'").groupBy("source_id").agg(F.max("started_at").alias("since"))


def newer(items: DataFrame, marks: DataFrame) -> DataFrame:
    """Items published after their source's watermark, undated items, and all items of sources without one."""
    return items.join(marks, "source_id", "left").filter("published_at > since OR published_at IS NULL OR since IS NULL").drop("since")


def poll_totals(events: DataFrame) -> DataFrame:
    """Items seen, new and repeated over all polls."""
    return events.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("items_seen", "snapshots_new", "snapshots_dup")])


def pending(snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """Snapshots that wait for ingestion, oldest first."""
    rows = snapshots.filter("extraction_status = 'pending'").orderBy("fetched_at", "content_hash")
    return rows if limit is None else rows.limit(limit)


def search(snapshots: DataFrame, source: str | None = None, text: str | None = None, limit: int = 50) -> DataFrame:
    """The latest snapshots of a source whose title or url has the text, case aside."""
    rows = snapshots if source is None else snapshots.filter(F.col("source_id") == source)
    if text is not None:
        like = "%" + text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"
        rows = rows.filter(F.col("title").ilike(like) | F.col("url").ilike(like))
    return rows.orderBy(F.desc("fetched_at"), "content_hash").limit(limit)


def window_scan(chunks: DataFrame, now: datetime, hours: int = 24, limit: int | None = 500) -> DataFrame:
    """Chunks of the last hours, newest first; ordered before they are limited. Pass scoped rows."""
    since = F.lit(now) - F.make_interval(hours=F.lit(hours))
    rows = chunks.filter(F.col("published_at") >= since).orderBy(F.desc("published_at"), "chunk_id")
    return rows if limit is None else rows.limit(limit)
