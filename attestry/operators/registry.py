"""The registry of sources: scope, tiers, gaps and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strings

#: What a source row has. tags: tag -> tier (1 to 3).
SCHEMA = "source_id string, name string, adapter string, language string, license string, tags map<string,int>, independence_group string, status string, endpoints array<string>"


def tier_in(tags: Column, include_tags: list[str]) -> Column:
    """The least tier over the included tags; null if the source has none of them."""
    return F.array_min(F.filter(F.transform(strings(include_tags), lambda t: F.element_at(tags, t)), lambda t: t.isNotNull()))


def in_scope(registry: DataFrame, include_tags: list[str], min_tier: int = 3) -> DataFrame:
    """Active sources with an included tag of tier ``min_tier`` or better, with that tier. The only way in
    which other operators choose sources. Null tags or status: out of scope."""
    tier = tier_in(F.col("tags"), include_tags)
    return registry.filter((F.col("status") == "active") & (tier <= min_tier)).withColumn("tier", tier)


def scoped(rows: DataFrame, registry: DataFrame, include_tags: list[str], min_tier: int = 3) -> DataFrame:
    """Rows of in-scope sources only."""
    return rows.join(in_scope(registry, include_tags, min_tier).select("source_id"), "source_id", "left_semi")


def with_source(rows: DataFrame, registry: DataFrame, include_tags: list[str]) -> DataFrame:
    """Add tier and independence_group (the source's own id where it has none) by source_id; unknown sources keep null tier."""
    own = registry.select("source_id", tier_in(F.col("tags"), include_tags).alias("tier"), F.col("independence_group").alias("_group"))
    return rows.join(own, "source_id", "left").withColumn("independence_group", F.coalesce(F.nullif("_group", F.lit("")), "source_id")).drop("_group")


def tag_gaps(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tags of ``wanted`` (tag) that no source bears."""
    return wanted.select("tag").distinct().join(registry.select(F.explode(F.map_keys("tags")).alias("tag")), "tag", "left_anti")


def problems(registry: DataFrame, profiles: DataFrame, adapters: list[str]) -> DataFrame:
    """What is wrong with a registry and its profiles (domain, include_tags, min_tier, cron): one row each."""
    unknown = registry.filter(~F.col("adapter").isin(adapters)).select(F.lit("unknown adapter").alias("problem"), F.concat_ws(": ", "source_id", "adapter").alias("subject"))
    asked = profiles.select("domain", "min_tier", F.explode("include_tags").alias("tag"))
    served = asked.join(registry.filter("status = 'active'").select(F.explode("tags").alias("tag", "tier")), "tag").filter("tier <= min_tier")
    empty = profiles.join(served, "domain", "left_anti").select(F.lit("no source in scope").alias("problem"), F.col("domain").alias("subject"))
    gaps = tag_gaps(registry, asked).select(F.lit("tag without a source").alias("problem"), F.col("tag").alias("subject"))
    cron = profiles.filter(~valid_cron(F.col("cron"))).select(F.lit("bad schedule").alias("problem"), F.concat_ws(": ", "domain", "cron").alias("subject"))
    twice = registry.groupBy("source_id").count().filter("count > 1").select(F.lit("repeated id").alias("problem"), F.col("source_id").alias("subject"))
    named = registry.filter(~F.col("source_id").rlike(r"^[a-z0-9_\-]+$")).select(F.lit("bad id").alias("problem"), F.col("source_id").alias("subject"))
    return unknown.unionByName(empty).unionByName(gaps).unionByName(cron).unionByName(twice).unionByName(named)


def valid_cron(cron: Column) -> Column:
    """Whether a five-field schedule has fields in range."""
    n = lambda hi: rf"(?:{hi})"
    minute, hour, day, month, week = n("[0-5]?\\d"), n("[01]?\\d|2[0-3]"), n("0?[1-9]|[12]\\d|3[01]"), n("0?[1-9]|1[0-2]"), n("[0-7]")
    field = lambda x: rf"(?:\*|{x}(?:-{x})?)(?:/\d+)?(?:,(?:\*|{x}(?:-{x})?)(?:/\d+)?)*"
    return F.coalesce(cron.rlike("^" + r"\s+".join(field(x) for x in (minute, hour, day, month, week)) + "$"), F.lit(True))
