"""The model's relations over the generated tables: which table stands for which relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as snapshots, one minute apart from 2024-01-01."""
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return d.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.col("source").alias("source_id"), "text", "lang", at.alias("published_at"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of documents: srcN has tier 1 + N % 3 in tag tN%2, group gN/4, and is paused if N % 10 is 9."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    s = table(spark, sf_dir, "documents").select("source").distinct().withColumn("n", n)
    tag = F.concat(F.lit("t"), (F.col("n") % 2).cast("string"))
    return s.select(F.col("source").alias("source_id"), F.col("source").alias("name"), F.lit("files").alias("adapter"), F.create_map(tag, F.col("n") % 3 + 1).alias("tags"), F.concat(F.lit("g"), F.floor(F.col("n") / 4).cast("string")).alias("independence_group"), F.when(F.col("n") % 10 == 9, "paused").otherwise("active").alias("status"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls_of(table(spark, sf_dir, "events"))


def polls_of(e: DataFrame) -> DataFrame:
    """events as polls: the user is the source, type error a failed one, value the items."""
    failed = F.col("event_type") == "error"
    return e.select(F.col("user_id").cast("string").alias("source_id"), "event_id", F.col("ts").cast("timestamp").alias("started_at"), F.when(failed, "error").otherwise("ok").alias("status"), F.floor("value").cast("long").alias("items_seen"), F.lit(0).cast("long").alias("snapshots_new"), F.when(failed, F.col("props")).alias("error"))


#: A dictionary of surface forms that occur in the prose.
DICTIONARY = [
    ("Apache License", "license:apache", "license"), ("License", "license:any", "license"), ("Licensed under", "license:any", "license"),
    ("pathetic", "tone:bad", "tone"), ("worthless", "tone:bad", "tone"), ("loser", "tone:bad", "tone"),
    ("trash", "waste", "thing"), ("Pathetic", "ignored", "tone"), ("thing", "thing", "thing"), ("clown", "clown", "thing"), ("the thing", "thing", "thing"),
]
#: Golden sentences and a denial: (sid, source_id, tier, cluster, claim).
GOLDEN = [
    ("S1", "harbour_office", 1, "c-ferry-1", "The harbour office cancelled all evening ferries to the islands because of thick fog."),
    ("S2", "coast_daily", 2, "c-ferry-2", "The harbour office cancelled all evening ferries to the islands, the pilots said."),
    ("S3", "valley_news", 2, "c-mill-1", "Two paper mills in the valley plan to share one water treatment plant from next spring."),
    ("S4", "city_desk", 1, "c-bridge-1", "Engineers shut the old railway bridge for repairs after last week's inspection."),
    ("S5", "rail_board", 2, "c-bridge-2", "Officials denied engineers shut the old railway bridge for repairs."),
]
