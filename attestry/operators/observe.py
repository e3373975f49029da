"""Source health, golden sets and counters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .substrings import occurrences


def source_health(events: DataFrame, registry: DataFrame, now: datetime, window_hours: int = 24) -> DataFrame:
    """One row per source of the registry (source_id) from its polls (source_id, event_id, started_at, status,
    items_seen, snapshots_new, error).

    Failures in a row are those after the latest poll that did not fail, over all history: none is ok, one
    or two degraded, more failing; without polls a source is unknown. Sums are of the window. Two
    aggregations with partial sums and no sort; polls at one time are ordered by event_id.
    """
    at, failed = F.struct("started_at", "event_id"), F.col("status") == "error"
    good = events.groupBy("source_id").agg(F.max(F.when(~failed, at)).alias("_ok"))
    inside = F.col("started_at") >= F.lit(now) - F.make_interval(hours=F.lit(window_hours))
    total = lambda c: F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0))
    worded = F.nullif("error", F.lit("")).isNotNull()
    per = events.join(good, "source_id").groupBy("source_id", "_ok").agg(
        F.count_if(failed & (F.col("_ok").isNull() | (at > F.col("_ok")))).alias("consecutive_failures"), F.max_by("status", at).alias("last_status"),
        F.count_if(inside).alias("events_in_window"), total("items_seen").alias("items_in_window"), total("snapshots_new").alias("new_in_window"), F.max_by("error", F.when(worded, at)).alias("last_error"),
    )
    n = F.col("consecutive_failures")
    status = F.when(n.isNull(), "unknown").when(n == 0, "ok").when(n < 3, "degraded").otherwise("failing")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return registry.select("source_id").join(per, "source_id", "left").select("source_id", status.alias("status"), "last_status", F.col("_ok.started_at").alias("last_ok_at"), zero("consecutive_failures"), zero("events_in_window"), zero("items_in_window"), zero("new_in_window"), "last_error")


def golden_outcomes(expectations: DataFrame, claims: DataFrame) -> DataFrame:
    """Whether each expectation (case, needle, claim_type, verdict) passes over claims (case, text, claim_type, verdict).

    It passes if some claim of its case (and type, if it names one) has the needle in its text, case aside, and all of
    those have the verdict. Equal expectations count once. Needles are found by a q-gram index of the case's texts; an
    empty needle is in all of them. Null cases, needles and texts meet nothing.
    """
    low = claims.select("case", F.lower("text").alias("_t"), "claim_type", "verdict").withColumn("_text_key", F.md5("_t"))
    texts = written(low.groupBy("case", "_text_key").agg(F.first("_t").alias("text")).withColumn("id", F.monotonically_increasing_id()), "texts")
    wanted = written(expectations.distinct().withColumns({"_n": F.monotonically_increasing_id(), "_key": F.md5(F.lower("needle"))}), "expectations")
    needles = wanted.groupBy("case", "_key").agg(F.first(F.lower("needle")).alias("text"))
    needles = written(needles.withColumn("id", F.monotonically_increasing_id()), "needles")
    pairs = occurrences(needles.withColumnRenamed("case", "key"), texts.withColumnRenamed("case", "key"))
    # what each text's claims say, then what the claims of each needle say
    kinds = low.select("case", "_text_key", "claim_type", "verdict").distinct()
    told = kinds.join(texts.select("case", "_text_key", F.col("id").alias("text_id")), ["case", "_text_key"]).select("text_id", "case", "claim_type", "verdict")
    by_text = pairs.join(told.drop("case"), "text_id").select("needle_id", "claim_type", "verdict").distinct()
    empty = needles.filter("text = ''").select(F.col("id").alias("needle_id"), "case")
    said = by_text.unionByName(empty.join(told.select("case", "claim_type", "verdict").distinct(), "case").select("needle_id", "claim_type", "verdict"))
    said = said.select("needle_id", F.col("claim_type").alias("_type"), F.col("verdict").alias("_verdict"))
    # without the needles' texts, which join at the end
    asked = wanted.drop("needle").join(needles.select("case", "_key", F.col("id").alias("needle_id")), ["case", "_key"], "left")
    met = asked.join(said, (asked["needle_id"] == said["needle_id"]) & (F.col("claim_type").isNull() | (F.col("claim_type") == F.col("_type"))), "left")
    agree = F.coalesce(F.bool_and(F.col("_verdict") == F.col("verdict")), F.lit(False))
    done = met.groupBy("_n").agg(agree.alias("passed"), F.array_sort(F.collect_set("_verdict")).alias("got"))
    return wanted.join(done, "_n").select(*expectations.columns, "passed", "got")


def golden_report(outcomes: DataFrame, precisions: DataFrame, pass_target: float = 1.0, precision_target: float = 0.95) -> DataFrame:
    """Pass rate over all expectations and the least precision of a case, 1 where there are none, against the targets."""
    rate = outcomes.agg(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(1.0)).alias("expectation_pass_rate"))
    least = precisions.agg(F.coalesce(F.min("precision"), F.lit(1.0)).alias("citation_precision"))
    # two single rows
    one = rate.withColumn("_k", F.lit(1)).join(least.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("ok", (F.col("expectation_pass_rate") >= pass_target) & (F.col("citation_precision") >= precision_target))


def ingest_stats(snapshots: DataFrame) -> DataFrame:
    """Snapshots by extraction status, and how many joined another's cluster."""
    joined = F.count_if(F.col("cluster_id").isNotNull() & (F.col("cluster_id") != F.substring("content_hash", 1, 16)))
    return snapshots.groupBy("extraction_status").agg(F.count("*").alias("n"), joined.alias("clusters_joined"))


def overview(health: DataFrame) -> DataFrame:
    """How many sources are in each state."""
    return health.groupBy("status").agg(F.count("*").alias("sources"), F.sum("items_in_window").alias("items"))


def overview_counts(snapshots: DataFrame, runs: DataFrame, candidates: DataFrame, health: DataFrame) -> DataFrame:
    """(name, n): snapshots, runs, pending candidates, and sources by state ("sources_ok", ...)."""
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    states = health.groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("sources_"), "status").alias("name"), "n")
    return counted(snapshots, "snapshots").unionByName(counted(runs, "runs")).unionByName(counted(candidates.filter("status = 'pending'"), "pending_candidates")).unionByName(states)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each domain."""
    others = [c for c in runs.columns if c != "domain"]
    return runs.groupBy("domain").agg(F.max_by(F.struct(*others), F.struct("started_at", "run_id")).alias("r")).select("domain", "r.*")


def listed_runs(runs: DataFrame, domain: str | None = None, workload: str | None = None, limit: int = 50) -> DataFrame:
    """Runs of a domain and workload, newest first."""
    for c, v in (("domain", domain), ("workload", workload)):
        runs = runs if v is None else runs.filter(F.col(c) == v)
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)
