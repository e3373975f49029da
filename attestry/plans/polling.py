"""The poll loop: sources in scope are read one by one, new contents are stored, every poll leaves an event."""

from __future__ import annotations

import traceback
from collections.abc import Callable
from datetime import datetime
from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import registry as scopes
from ..operators import snapshots
from ..sources import conditional
from ..sources.config import Profile
from ..sources.readers import adapter, since
from ..storage import exists, written

EVENT = "source_id string, domain string, started_at timestamp, finished_at timestamp, status string, items_seen long, snapshots_new long, snapshots_dup long, error string, registry_commit string"
SNAPSHOT = "content_hash string, source_id string, url string, title string, content binary, media_type string, published_at timestamp, fetched_at timestamp, ord long"

#: Reads a source's items (url, title, content, media_type, published_at) that are later than a time.
Reader = Callable[[SparkSession, Row, datetime | None], DataFrame]


def read_stored(spark: SparkSession, source: Row, after: datetime | None) -> DataFrame:
    """The items of a source by its adapter, over stored answers at its endpoints."""
    found = None
    for e in source["endpoints"]:
        one = adapter(source["adapter"])(spark, e, after=after)
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError(f"source {source['source_id']!r} has no endpoints")
    return found


class Store:
    """Snapshots and poll events below one folder, each an append-only Parquet table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    @property
    def snapshots(self) -> DataFrame:
        return self._table("snapshots", SNAPSHOT)

    @property
    def events(self) -> DataFrame:
        return self._table("events", EVENT)

    @property
    def states(self) -> DataFrame:
        """What endpoints said of their validators."""
        return self._table("states", conditional.STATE)

    def put(self, items: DataFrame) -> int:
        """Store the contents that the store does not hold, one row each; returns how many."""
        new = written(snapshots.first_writers(items, self.snapshots).select(*[c.split()[0] for c in SNAPSHOT.split(", ")]), "new")
        n = new.count()
        if n:
            new.write.mode("append").parquet(f"{self.folder}/snapshots")
        return n

    def log(self, event: tuple) -> None:
        self.spark.createDataFrame([event], EVENT).write.mode("append").parquet(f"{self.folder}/events")


class ConditionalReader:
    """A reader of feeds that asks only for what has changed: ``request`` brings the answers (url, status, body, etag,
    last_modified) to requests (source_id, url, etag, last_modified).

    What endpoints say of their validators goes into the store by commit(), after the items: were a poll to end in between,
    the next one asks as this one did. An endpoint that fails is an error of its source. NotModified is raised if all
    endpoints answer 304.
    """

    def __init__(self, store: Store, request: Callable[[DataFrame], DataFrame], clock: Callable[[], datetime] = datetime.now):
        self.store, self.request, self.clock, self.new = store, request, clock, {}

    def __call__(self, spark: SparkSession, source: Row, after: datetime | None) -> DataFrame:
        i = source["source_id"]
        one = spark.createDataFrame([(i, list(source["endpoints"]))], "source_id string, endpoints array<string>")
        asked = written(conditional.requests(one, self.store.states), "requests")
        answers = written(self.request(asked), "answers")
        status = conditional.outcomes(asked, answers).first()["status"]
        if status == "error":
            raise OSError(f"an endpoint of {i!r} failed")
        self.new[i] = conditional.merged(self.store.states, asked, answers, self.clock())
        if status == "not_modified":
            raise conditional.NotModified(i)
        return since(conditional.items_of(answers), after)

    def commit(self, source_id: str) -> None:
        if source_id in self.new:
            written(self.new.pop(source_id), "states").write.mode("append").parquet(f"{self.store.folder}/states")


def poll(store: Store, sources: DataFrame, profile: Profile, read: Reader = read_stored, only_source: str | None = None, dry_run: bool = False, registry_commit: str | None = None, clock: Callable[[], datetime] = datetime.now) -> list[dict]:
    """Poll the sources of a profile's scope; one result (source_id, status, items_seen, snapshots_new,
    snapshots_dup, error) each.

    A source that fails is told as an error, keeps its watermark and stores nothing; the others go on. One that says that
    nothing has changed is told as not_modified, which is no failure. The
    watermark of one that succeeds is the start of its poll: items later than it are asked for next time. A dry
    run stores nothing, no event either. ``only_source`` out of scope is an error. Sources are few and each one
    is read by a job of its own, so the loop is the driver's.
    """
    spark = store.spark
    due = scopes.in_scope(sources, profile.include_tags, profile.min_tier).select("source_id")
    due = sources.join(due.distinct(), "source_id", "left_semi").orderBy("source_id").collect()
    if only_source is not None:
        due = [s for s in due if s["source_id"] == only_source]
        if not due:
            raise KeyError(f"source {only_source!r} is not in the scope of {profile.domain!r}")
    marks = {r["source_id"]: r["since"] for r in snapshots.watermarks(store.events).collect()}
    results = []
    for s in due:
        i, started = s["source_id"], clock()
        out = {"source_id": i, "status": "ok", "items_seen": 0, "snapshots_new": 0, "snapshots_dup": 0, "error": None}
        try:
            found = read(spark, s, marks.get(i))
            raw = F.col("content").cast("binary")
            items = found.select(F.sha2(raw, 256).alias("content_hash"), F.lit(i).alias("source_id"), "url", "title", raw.alias("content"), "media_type", "published_at", F.lit(started).alias("fetched_at"), F.xxhash64("url", "title").alias("ord"))
            items = written(items, "items")
            out["items_seen"] = items.count()
            if not dry_run:
                out["snapshots_new"] = store.put(items)
                out["snapshots_dup"] = out["items_seen"] - out["snapshots_new"]
            else:
                out["status"] = "skipped_dry_run"
        except conditional.NotModified:
            out["status"] = "skipped_dry_run" if dry_run else "not_modified"
        except (PySparkException, OSError, ValueError, KeyError, RuntimeError) as e:
            out |= {"status": "error", "error": f"{type(e).__name__}: {str(e)[:500]}", "trace": traceback.format_exc(), "snapshots_new": 0, "snapshots_dup": 0}
        if not dry_run:
            if out["status"] in ("ok", "not_modified") and isinstance(read, ConditionalReader):
                read.commit(i)
            store.log((i, profile.domain, started, clock(), out["status"], out["items_seen"], out["snapshots_new"], out["snapshots_dup"], out["error"], registry_commit))
        results.append(out)
    return results


def totals(results: list[dict]) -> tuple[int, int, int]:
    """Items seen, new and repeated over all results."""
    return tuple(sum(r[c] for r in results) for c in ("items_seen", "snapshots_new", "snapshots_dup"))


def registry_commit(path: str) -> str | None:
    """The last commit that touched a file, with "-dirty" if it has changed since; None outside a repository."""
    import subprocess

    folder, name = str(PurePosixPath(path).parent), PurePosixPath(path).name

    def git(*args: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, timeout=10, check=False)
        except (OSError, subprocess.TimeoutExpired):
            return None
        return done.stdout.strip() if done.returncode == 0 else None

    last = git("log", "-n", "1", "--format=%h", "--", name)
    if not last:
        return None
    return last + ("-dirty" if git("status", "--porcelain", "--", name) else "")
