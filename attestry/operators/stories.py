"""Stories: clusters of window chunks, their headlines and evidence ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_stories(chunks: DataFrame, max_stories: int = 20, chunks_per_story: int = 3) -> DataFrame:
    """Evidence rows of the newest stories.

    chunks: chunk_id, cluster_id, content_hash, title, text, published_at. A story is a cluster (the hash's
    first 16 digits where there is none). Its headline is the first title by (published_at, chunk_id)
    descending over all members, else the first line of the first one's text, 90 characters at most. Stories
    come newest first, ties by story id; their newest chunks are S1, S2, ... Headline and newest are
    aggregated; only the few chosen stories' chunks are ranked.
    """
    c = chunks.withColumn("story", F.coalesce("cluster_id", F.substring("content_hash", 1, 16)))
    at = F.struct(F.coalesce("published_at", F.lit("1970-01-01").cast("timestamp")).alias("t"), "chunk_id")
    titled = F.nullif("title", F.lit(""))
    line = F.substring(F.element_at(F.split(F.btrim("text"), r"\R"), 1), 1, 90)
    heads = c.groupBy("story").agg(F.max(at).alias("m"), F.max_by(titled, F.when(titled.isNotNull(), at)).alias("title"), F.max_by(line, at).alias("line"))
    few = heads.orderBy(F.desc("m.t"), "story").limit(max_stories).select("story", F.col("m.t").alias("newest"), F.coalesce("title", "line").alias("headline"))
    ranked = c.drop("title").join(F.broadcast(few), "story").withColumn("position", F.row_number().over(Window.partitionBy("story").orderBy(F.desc("published_at"), F.desc("chunk_id")))).filter(F.col("position") <= chunks_per_story)
    # at most max_stories * chunks_per_story rows
    return ranked.withColumn("n", F.row_number().over(Window.orderBy(F.desc("newest"), "story", "position"))).withColumn("sid", F.concat(F.lit("S"), F.col("n").cast("string")))
