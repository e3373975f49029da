"""Candidate sources: proposals and decisions on them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import netloc, source_stub_id


def propose(links: DataFrame, registry_urls: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Hosts of links (ord, url, title) that neither the registry's urls (url) nor earlier candidates (netloc) have.

    One row per host: its first link, how many there are, and the id that it would have.
    """
    seen = links.withColumn("netloc", netloc(F.col("url"))).filter("netloc <> ''").groupBy("netloc").agg(F.min_by(F.struct("url", "title"), "ord").alias("_f"), F.count("*").alias("links"))
    new = seen.join(registry_urls.select(netloc(F.col("url")).alias("netloc")).distinct(), "netloc", "left_anti")
    if candidates is not None:
        new = new.join(candidates.select("netloc").distinct(), "netloc", "left_anti")
    return new.select("netloc", "_f.url", "_f.title", "links", source_stub_id(F.col("netloc")).alias("stub_id"), F.lit("pending").alias("status"))


def decided(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates (netloc, ...) with their latest decision of the log (netloc, decided_at, status, reason)."""
    last = log.groupBy("netloc").agg(F.max_by(F.struct("status", "reason"), "decided_at").alias("_d"))
    return candidates.drop("status", "reason").join(last, "netloc", "left").select(*[c for c in candidates.columns if c not in ("status", "reason")], F.coalesce("_d.status", F.lit("pending")).alias("status"), F.col("_d.reason").alias("reason"))


def decision(candidates: DataFrame, netloc: str, status: str, at: datetime, reason: str | None = None) -> DataFrame:
    """The log row that approves or rejects a candidate. One that is not there is an error, so is a rejection without
    a reason. Approving changes no registry: stanza gives the entry to review."""
    if status not in ("approved", "rejected"):
        raise ValueError(f"unknown decision {status!r}")
    if status == "rejected" and not reason:
        raise ValueError("a rejection needs a reason")
    if candidates.filter(F.col("netloc") == netloc).isEmpty():
        raise KeyError(f"no candidate {netloc!r}")
    return candidates.sparkSession.createDataFrame([(netloc, at, status, reason)], "netloc string, decided_at timestamp, status string, reason string")


def listed(candidates: DataFrame, status: str = "pending") -> DataFrame:
    """Candidates of a status; all of them for "all"."""
    return candidates if status == "all" else candidates.filter(F.col("status") == status)


def stanza(candidates: DataFrame) -> DataFrame:
    """The registry entry to review for each candidate, as YAML."""
    lines = F.concat_ws("\n", F.concat(F.lit("- id: "), "stub_id"), F.concat(F.lit("  name: "), F.coalesce("title", "netloc")), F.concat(F.lit("  homepage: https://"), "netloc"), F.lit("  status: paused"), F.lit("  license: UNREVIEWED"))
    return candidates.withColumn("yaml", lines)
