"""The golden harness: cases of a YAML file go through the engine, and what comes out is held against them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, corroborate, observe
from ..sources.config import Profile
from ..storage import written
from .workflows import Seams

DOC = "case string, n long, sid string, source_id string, cluster_id string, independence_group string, tier int, entity_ids array<string>, published_at timestamp, title string, text string"


def load_cases(path: str) -> dict:
    """targets and cases: name, docs (source_id, text, and tier, cluster, group, title, entity_ids, published_at),
    expect (claim_contains, verdict, and claim_type)."""
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def run_golden(spark: SparkSession, profile: Profile, path: str, seams: Seams = Seams()) -> dict[str, DataFrame]:
    """outcomes (case, needle, claim_type, verdict, passed, got), precisions (case, precision) and report.

    Each case's documents are its evidence S1, S2, ...; claims are extracted and corroborated, and a body is
    written and checked, case by case. Cases are a few handwritten documents; they run together where the engine's
    own stages do, since claims of different cases never meet in one group.
    """
    spec = load_cases(path)
    cases = spec.get("cases") or []
    docs, wanted = [], []
    for c in cases:
        group = {}
        for d in c["docs"]:
            group.setdefault(d["source_id"], d.get("group") or d["source_id"])
        docs += [(c["name"], i, f"S{i}", d["source_id"], d.get("cluster") or f"cl-{i}", group[d["source_id"]], d.get("tier"), d.get("entity_ids") or [], d.get("published_at"), d.get("title") or d["source_id"], d["text"]) for i, d in enumerate(c["docs"], 1)]
        wanted += [(c["name"], e["claim_contains"], e.get("claim_type"), e["verdict"]) for e in c.get("expect") or []]
    evidence = written(spark.createDataFrame(docs, DOC), "golden")
    expectations = spark.createDataFrame(wanted, "case string, needle string, claim_type string, verdict string")
    found = seams.extract(evidence.select("case", "n", "sid", "source_id", "cluster_id", "independence_group", "tier", "entity_ids", "published_at", "text"))
    found = written(found.withColumn("id", claims.claim_id(F.col("n"), F.col("line"), F.col("pos"))), "golden-claims")
    verdicts, precisions = None, None
    shared = ["claim_group", "text", "claim_type", "verdict", "independent_voices", "tier1_voices", "sids", "sources", "story_cluster", "conflict", "dropped"]
    for c in cases:
        own, seen = found.filter(F.col("case") == c["name"]), evidence.filter(F.col("case") == c["name"]).withColumn("body_id", F.lit(1))
        told, numbers = own.filter("claim_type = 'event'"), own.filter("claim_type = 'quantitative'")
        events = corroborate.corroborate_events(told, profile.event, seams.match(told) if seams.match else None).select(*shared)
        quants = corroborate.corroborate_quantities(numbers, profile.quantitative, profile.relative, profile.absolute)
        quants = quants.withColumn("claim_group", F.xxhash64("claim_group").bitwiseAND(F.lit((1 << 62) - 1)) + (1 << 61)).select(*shared)
        done = written(events.unionByName(quants), "golden-verdicts")
        checks = seams.verify(seams.synthesize(done.withColumn("body_id", F.lit(1)), seen), seen)
        score = checks.agg(F.coalesce(F.avg(F.col("supported").cast("double")), F.lit(1.0)).alias("precision")).select(F.lit(c["name"]).alias("case"), "precision")
        done = done.select(F.lit(c["name"]).alias("case"), "text", "claim_type", "verdict")
        verdicts = done if verdicts is None else verdicts.unionByName(done)
        precisions = score if precisions is None else precisions.unionByName(score)
    if verdicts is None:
        verdicts = spark.createDataFrame([], "case string, text string, claim_type string, verdict string")
        precisions = spark.createDataFrame([], "case string, precision double")
    outcomes, precisions = written(observe.golden_outcomes(expectations, verdicts), "outcomes"), written(precisions, "precisions")
    targets = spec.get("targets") or {}
    report = observe.golden_report(outcomes, precisions, targets.get("expectation_pass_rate", 1.0), targets.get("citation_precision", 0.95))
    return {"verdicts": verdicts, "outcomes": outcomes, "precisions": precisions, "report": report}
