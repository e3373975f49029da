"""Conditional requests: what is remembered of endpoints, so that an unchanged feed is neither sent nor parsed again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .answers import feed_entries

#: What is remembered of a source's endpoint; the row of the latest time counts.
STATE = "source_id string, endpoint string, etag string, last_modified string, status int, checked_at timestamp"


class NotModified(Exception):
    """All endpoints of a source say that nothing has changed."""


def requests(sources: DataFrame, states: DataFrame) -> DataFrame:
    """(source_id, url, etag, last_modified): one request per endpoint of sources (source_id, endpoints).

    Only sources with one endpoint ask conditionally, by what their last good answer said; others get nulls.
    """
    known = current(states).select("source_id", F.col("endpoint").alias("url"), "etag", "last_modified")
    asked = sources.select("source_id", F.explode("endpoints").alias("url"), (F.size("endpoints") == 1).alias("_one"))
    found = asked.join(known, ["source_id", "url"], "left")
    return found.select("source_id", "url", *[F.when(F.col("_one"), F.col(c)).alias(c) for c in ("etag", "last_modified")])


def current(states: DataFrame) -> DataFrame:
    """The latest state of each endpoint."""
    others = F.struct("etag", "last_modified", "status", "checked_at")
    return states.groupBy("source_id", "endpoint").agg(F.max_by(others, "checked_at").alias("s")).select("source_id", "endpoint", "s.*")


def merged(states: DataFrame, asked: DataFrame, answers: DataFrame, at: datetime) -> DataFrame:
    """New states of what was asked (source_id, url, ...), by the answers (url, status, etag, last_modified).

    A good answer puts its validators in place of the old ones, as far as it has them; a 304 and a failure keep them. An
    endpoint that did not answer gets no row.
    """
    before = current(states).select("source_id", F.col("endpoint").alias("url"), F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"))
    said = answers.select("url", F.coalesce("status", F.lit(200)).cast("int").alias("status"), "etag", "last_modified")
    rows = asked.select("source_id", "url").join(said, "url").join(before, ["source_id", "url"], "left")
    new = lambda c, old: F.when((F.col("status") < 400) & (F.col("status") != 304), F.coalesce(c, old)).otherwise(F.col(old)).alias(c)
    return rows.select("source_id", F.col("url").alias("endpoint"), new("etag", "_etag"), new("last_modified", "_modified"), "status", F.lit(at).cast("timestamp").alias("checked_at"))


def outcomes(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(source_id, status): error if an endpoint failed or did not answer, not_modified if all said 304, else ok."""
    said = answers.select("url", F.coalesce("status", F.lit(200)).alias("_status"))
    per = asked.join(said, "url", "left").groupBy("source_id")
    failed = F.bool_or(F.col("_status").isNull() | (F.col("_status") >= 400))
    return per.agg(F.when(failed, "error").when(F.bool_and(F.col("_status") == 304), "not_modified").otherwise("ok").alias("status"))


def items_of(answers: DataFrame) -> DataFrame:
    """Items (url, title, content, media_type, published_at) of the good answers (url, status, body) of feeds."""

    def parse(batches):
        import pandas as pd

        for batch in batches:
            rows = [e for body in batch["body"] for e in feed_entries(None if body is None else bytes(body))]
            yield pd.DataFrame(rows, columns=["url", "title", "content", "published_at"]).assign(media_type="text/html")[["url", "title", "content", "media_type", "published_at"]]

    good = answers.filter((F.coalesce("status", F.lit(200)) < 400) & (F.coalesce("status", F.lit(200)) != 304))
    return good.select("body").mapInPandas(parse, "url string, title string, content string, media_type string, published_at timestamp")
