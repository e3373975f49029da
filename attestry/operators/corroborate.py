"""Corroboration: which claims say the same, how many independent voices say it, and the verdict."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import NEGATIONS, strings, tokenize
from ..storage import sent, written
from .alike import alike_groups
from .graph import components
from .near_duplicates import similar_sets


@dataclass(frozen=True)
class Policy:
    """When a claim is confirmed, and what happens to one that is not: attribute, flag or drop."""

    min_sources: int = 2
    min_tier1: int = 1
    fallback: str = "attribute"


def event_tokens(claim: Column) -> Column:
    """Distinct tokens of a claim without negations, so that a denial still matches what it denies."""
    return F.array_except(tokenize(claim), strings(NEGATIONS))


def event_pairs(claims: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, jaccard, copy) of claims (id, claim; ids distinct) that state one event: token likeness of ``threshold`` or more.

    All pairs a < b of different texts, each by its first claim, and (first, other, 1, true) for every other claim of a text: it
    has all links of the first, and one with each claim of its own text. Claims without tokens match nothing, not even an equal claim.
    """
    tokens = F.transform(event_tokens(F.col("claim")), lambda t: F.xxhash64(t))
    firsts = claims.groupBy("claim").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", tokens.alias("s"), F.sha2("claim", 256).alias("h"))
    firsts = written(firsts, "claims")
    pairs = similar_sets(firsts.select("id", "s"), threshold, short=True)
    # texts of one claim have no copies, and most are
    copied = sent(firsts.filter((F.col("n") > 1) & (F.size("s") > 0)).select("h", F.col("id").alias("a")), "copied")
    copies = claims.select(F.col("id").alias("b"), F.sha2("claim", 256).alias("h")).join(copied, "h").filter("a <> b").select("a", "b", F.lit(1.0).alias("jaccard"), F.lit(True).alias("copy"))
    return pairs.withColumn("copy", F.lit(False)).unionByName(copies)


def event_groups(claims: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, root): claims of one event, through any chain of pairs; root is the first claim. Claims with equal tokens are
    represented by one set, and pairs are never listed, however many claims are alike."""
    tokens = F.transform(event_tokens(F.col("claim")), lambda t: F.xxhash64(t))
    # a claim's text moves once, to be told from others; after that its sets do
    firsts = claims.groupBy("claim").agg(F.min("id").alias("first")).select("first", F.array_sort(tokens).alias("s"), F.sha2("claim", 256).alias("h"))
    firsts = written(firsts.withColumn("node", F.xxhash64("s")), "claims")
    sets = firsts.filter(F.size("s") > 0).groupBy("node").agg(F.first("s").alias("s"))
    roots = alike_groups(sets, threshold, short=True)
    named = firsts.filter(F.size("s") > 0).select("first", "h", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("group"))
    # claims without tokens match nothing, not even an equal claim
    known = named.join(smallest, "root").select("h", "group")
    return claims.select("id", F.sha2("claim", 256).alias("h")).join(known, "h", "left").select("id", F.coalesce("group", "id").alias("root"))


def voices(evidence: DataFrame) -> DataFrame:
    """(claim_group, independent_voices, tier1_voices) of evidence (id, claim_group, cluster_id, independence_group, tier).

    Items of a claim group that share a non-null cluster or a non-empty independence group are one voice,
    through any chain. Each shared value links its items to one of them, so links follow the items. One of
    the items of a claim group's (cluster, independence group) pairs stands for all others. Ids are not looked at.
    """
    e = evidence.groupBy("claim_group", "cluster_id", "independence_group").agg(F.min(F.when(F.col("tier") == 1, 1)).alias("tier1"))
    node = F.xxhash64("claim_group", F.col("cluster_id").isNull(), "cluster_id", F.col("independence_group").isNull(), "independence_group")
    e = written(e.withColumn("id", node), "voices")
    links = None
    for c in ("cluster_id", "independence_group"):
        valued = e.filter(F.col(c).isNotNull() if c == "cluster_id" else F.coalesce(F.col(c), F.lit("")) != "")
        first = valued.groupBy("claim_group", c).agg(F.min("id").alias("a"))
        found = valued.join(first, ["claim_group", c]).filter("a < id").select("a", F.col("id").alias("b"))
        links = found if links is None else links.unionByName(found)
    roots = components(links).withColumnRenamed("node", "id")
    rooted = e.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # items without any shared value that were put together above are voices of their own
    alone = F.col("cluster_id").isNull() & (F.coalesce("independence_group", F.lit("")) == "")
    single = evidence.filter(alone).groupBy("claim_group").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("tier"), F.lit(0)) == 1).alias("t"))
    per = rooted.groupBy("claim_group").agg(F.countDistinct(F.when(~alone, F.col("root"))).alias("v"), F.countDistinct(F.when(~alone & (F.col("tier1") == 1), F.col("root"))).alias("v1"))
    total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
    return per.join(single, "claim_group", "left").select("claim_group", total("v", "n").alias("independent_voices"), total("v1", "t").alias("tier1_voices"))


def ruled(rows: DataFrame, policy: Policy, contradicted: Column) -> DataFrame:
    """Add verdict and dropped from independent_voices and tier1_voices."""
    enough = (F.col("independent_voices") >= policy.min_sources) & (F.col("tier1_voices") >= policy.min_tier1)
    below = F.lit("attributed" if policy.fallback == "attribute" else "insufficient")
    verdict = F.when(contradicted, "contradicted").when(enough, "confirmed").otherwise(below)
    return rows.withColumn("verdict", verdict).withColumn("dropped", ~contradicted & ~enough & F.lit(policy.fallback == "drop"))


def _merged() -> list[Column]:
    """What a group's evidence comes to: sids in numeric order, sources, and the first story."""
    number = F.transform(F.array_sort(F.collect_set(F.substring("sid", 2, 20).cast("long"))), lambda n: F.concat(F.lit("S"), n.cast("string")))
    return [number.alias("sids"), F.array_sort(F.collect_set("source_id")).alias("sources"), F.min_by("cluster_id", F.when(F.col("cluster_id").isNotNull(), F.col("id"))).alias("story_cluster")]


def corroborate_events(claims: DataFrame, policy: Policy = Policy(), groups: DataFrame | None = None) -> DataFrame:
    """One row per event of claims (id, claim, modality, sid, source_id, cluster_id, independence_group, tier).

    An event that is both asserted and denied is contradicted, with its first assertion as text; else the
    policy decides, with its first claim as text.
    """
    own = claims.select("id", "claim", "modality", "sid", "source_id", "cluster_id", "independence_group", "tier")
    rooted = own.join(event_groups(own) if groups is None else groups, "id")
    by = lambda m: F.array_join(F.array_sort(F.collect_set(F.when(F.col("modality") == m, F.col("source_id")))), ", ")
    said = lambda m: F.bool_or(F.col("modality") == m)
    first = F.min_by("claim", F.when(F.col("modality") == "asserted", F.col("id")))
    per = rooted.groupBy(F.col("root").alias("claim_group")).agg(F.min_by("claim", "id").alias("_any"), first.alias("_asserted"), (said("asserted") & said("denied")).alias("_both"), F.concat(F.lit("asserted by "), by("asserted"), F.lit("; denied by "), by("denied")).alias("_conflict"), *_merged())
    per = per.join(voices(rooted.withColumn("claim_group", F.col("root"))), "claim_group")
    out = ruled(per, policy, F.col("_both")).withColumn("text", F.when(F.col("_both"), F.col("_asserted")).otherwise(F.col("_any")))
    return out.withColumn("conflict", F.when(F.col("_both"), F.col("_conflict"))).withColumn("claim_type", F.lit("event")).drop("_any", "_asserted", "_both", "_conflict")


def agrees(a: float, v: float, relative: float | None, absolute: float | None) -> bool:
    return (absolute is not None and abs(a - v) <= absolute) or (relative is not None and abs(a - v) <= relative * max(abs(a), abs(v))) or a == v or (a != a and v != v)


def value_groups(values: DataFrame, key: list[str], relative: float | None, absolute: float | None) -> DataFrame:
    """Add anchor to values (key columns, v, others; v distinct within a key): ascending values join the first anchor
    that they agree with, else are one.

    Values agree within ``absolute``, or within ``relative`` of the larger; exactly if neither is set. While
    ``relative`` is below 1 only the last anchor can agree: one before it is too far from the last, which lies
    between. So a task goes through its sorted rows once and remembers one anchor; no key is gathered.
    """

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors = None, []
        for batch in batches:
            out = []
            for k, v in zip(zip(*(batch.column(c).to_pylist() for c in key), strict=True), batch.column("v").to_pylist(), strict=True):
                if k != at:
                    at, anchors = k, []
                found = next((a for a in (anchors if (relative or 0) >= 1 else anchors[-1:]) if agrees(a, v, relative, absolute)), None)
                if found is None:
                    anchors.append(found := v)
                    anchors = anchors if (relative or 0) >= 1 else anchors[-1:]
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "anchor"])

    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return values.repartition(n, *key).sortWithinPartitions(*key, "v").mapInArrow(grouped, StructType([*values.schema.fields, StructField("anchor", DoubleType())]))


#: Claims of one key that a task may have in one row.
HELD = 50_000


def corroborate_quantities(claims: DataFrame, policy: Policy = Policy(), relative: float | None = 0.005, absolute: float | None = None) -> DataFrame:
    """One row per (entity_id, metric, as_of) of quantitative claims, nulls as "?" and "".

    More than one value group is a contradiction, told by its anchors in ascending order; a null value
    counts as 0; see value_groups for how values are grouped. Claims move once, to their key; keys of over ``HELD``
    claims are first summed up by value instead.
    """
    key = ["k_entity", "k_metric", "k_as_of"]
    c = claims.withColumns({"k_entity": F.coalesce("entity_id", F.lit("?")), "k_metric": F.coalesce("metric", F.lit("?")), "k_as_of": F.substring(F.coalesce("as_of", F.lit("")), 1, 10), "v": F.coalesce("value", F.lit(0.0)).cast("double")})
    if (relative or 0) >= 1:
        out = _summed(c, key, relative, absolute)
    else:
        crowded = written(c.groupBy(*key).count().filter(F.col("count") > HELD).select(*key), "crowded")
        if crowded.isEmpty():
            out = _held(c, key, relative, absolute)
        else:
            out = _held(c.join(F.broadcast(crowded), key, "left_anti"), key, relative, absolute).unionByName(_summed(c.join(F.broadcast(crowded), key, "left_semi"), key, relative, absolute))
    out = ruled(out, policy, F.col("_many")).withColumn("text", F.when(F.col("_many"), F.col("_least")).otherwise(F.col("_first")))
    return out.withColumn("claim_type", F.lit("quantitative")).withColumnsRenamed({"k_entity": "entity_id", "k_metric": "metric", "k_as_of": "as_of"}).drop("_first", "_many", "_least")


def _told(value: Column, unit: Column, by: Column) -> Column:
    return F.btrim(F.concat(value.cast("string"), F.lit(" "), F.coalesce(unit, F.lit("")), F.lit(" ("), F.array_join(by, ", "), F.lit(")")))


def _summed(c: DataFrame, key: list[str], relative: float | None, absolute: float | None) -> DataFrame:
    """What the claims of a key come to, by values: no key is gathered."""
    firsts = c.groupBy(*key).agg(F.min_by("claim", "id").alias("_first"), *_merged())
    values = c.groupBy(*key, "v").agg(F.min_by(F.struct("claim", "unit", "value"), "id").alias("own"), F.collect_set("source_id").alias("by"))
    groups = value_groups(values, key, relative, absolute).groupBy(*key, "anchor").agg(F.min_by("own", "v").alias("head"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("by")))).alias("by"))
    said = _told(F.col("head.value"), F.col("head.unit"), F.col("by"))
    many, told = F.count("*") > 1, F.transform(F.array_sort(F.collect_list(F.struct("anchor", said.alias("said")))), lambda x: x["said"])
    listed = groups.groupBy(*key).agg(many.alias("_many"), F.when(many, F.concat(F.lit("conflicting values: "), F.array_join(told, " vs "))).alias("conflict"), F.min_by("head.claim", "anchor").alias("_least"))
    return firsts.join(listed, key).withColumn("claim_group", F.struct(*key)).join(voices(c.withColumn("claim_group", F.struct(*key))), "claim_group")


def _held(c: DataFrame, key: list[str], relative: float | None, absolute: float | None) -> DataFrame:
    """The same for keys of few claims, each of them in one row."""

    @F.pandas_udf("array<int>")
    def starts(values: pd.Series) -> pd.Series:
        """Where the groups of ascending values start, from 1, and the place after the last."""

        def of(vs: np.ndarray) -> list[int]:
            out, anchor = [1], vs[0]
            for i, v in enumerate(vs[1:].tolist(), 2):
                if not agrees(anchor, v, relative, absolute):
                    out.append(i)
                    anchor = v
            return [*out, len(vs) + 1]

        return values.map(of)

    @F.pandas_udf("v long, t long")
    def joined(rows: pd.Series) -> pd.DataFrame:
        """Voices, and those of tier 1, of items that have a cluster or a group; none where the row is null."""
        return pd.DataFrame([(None, None) if x is None else _voices(x) for x in rows], columns=["v", "t"]).astype("Int64")

    cluster, group, top = F.col("cluster_id"), F.nullif(F.col("independence_group"), F.lit("")), F.coalesce(F.col("tier") == 1, F.lit(False))
    alone = cluster.isNull() & group.isNull()
    item = F.struct("v", "id", "claim", "unit", "value", "source_id", cluster.alias("c"), group.alias("g"), top.alias("t"))
    apart = {n: F.collect_set(F.when(top, x) if n[1:] else x) for n, x in (("c", cluster), ("g", group), ("c1", cluster), ("g1", group))}
    # one column: constants are taken out of several, and the aggregate would move all rows again
    per = c.withColumn("claim_group", F.struct(*key)).repartition("claim_group").groupBy("claim_group").agg(
        F.sort_array(F.collect_list(item)).alias("all"), F.min_by("claim", "id").alias("_first"), *_merged(), *[x.alias(f"_{n}") for n, x in apart.items()],
        F.bool_or(cluster.isNotNull() & group.isNotNull()).alias("_linked"), F.count_if(alone).alias("_v"), F.count_if(alone & top).alias("_t"),
    )
    items = F.filter("all", lambda x: x["c"].isNotNull() | x["g"].isNotNull())
    per = per.withColumns({"_starts": starts(F.transform("all", lambda x: x["v"])), "_j": joined(F.when(F.col("_linked"), F.transform(items, lambda x: F.struct(x["c"].alias("c"), x["g"].alias("g"), x["t"].alias("t")))))})
    cut = lambda k: F.slice("all", F.element_at("_starts", k), F.element_at("_starts", k + 1) - F.element_at("_starts", k))
    tell = lambda g: _told(F.element_at(g, 1)["value"], F.element_at(g, 1)["unit"], F.array_sort(F.array_distinct(F.transform(g, lambda x: x["source_id"]))))
    many, told = F.size("_starts") > 2, F.transform(F.transform(F.sequence(F.lit(1), F.size("_starts") - 1), cut), tell)
    # items with a cluster or a group only are linked by nothing else
    count = lambda j, a, b, n: (F.coalesce(F.col(f"_j.{j}"), F.size(a) + F.size(b)) + F.col(n)).cast("long")
    return per.select(
        "claim_group", "claim_group.*", "_first", "sids", "sources", "story_cluster", many.alias("_many"), F.when(many, F.concat(F.lit("conflicting values: "), F.array_join(told, " vs "))).alias("conflict"),
        F.element_at("all", 1)["claim"].alias("_least"), count("v", "_c", "_g", "_v").alias("independent_voices"), count("t", "_c1", "_g1", "_t").alias("tier1_voices"),
    )


def _voices(items: list[dict]) -> tuple[int, int]:
    """How many are apart when items of one cluster or one group are one, and how many of those have an item of tier 1."""
    root: dict[tuple, tuple] = {}

    def find(x: tuple) -> tuple:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    ends = [[(n, x[n]) for n in ("c", "g") if x[n] is not None] for x in items]
    for e in ends:
        root[find(e[0])] = find(e[-1])
    return len({find(e[0]) for e in ends}), len({find(e[0]) for e, x in zip(ends, items, strict=True) if x["t"]})


def verdict_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("verdict").agg(F.count("*").alias("n"))
