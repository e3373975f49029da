"""Runs: what is written of a brief or a report, the manifest that tells how it came about, and the run log."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import datetime
from pathlib import Path
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.config import Profile
from ..storage import exists, read_text, write_text

RUN = "run_id string, domain string, workload string, started_at timestamp, finished_at timestamp, status string, registry_commit string, models map<string,string>, manifest_path string, output_path string, error string"

#: Our own layout; a profile's file may stand for it. Fields: heading, domain, run_id, generated_at, scope, body,
#: sources, registry_commit, synthesizer, embedder.
LAYOUT = Template("""# $heading: $domain

Run `$run_id`, $generated_at, $scope

$body

## Evidence

$sources

## Provenance

Source registry `$registry_commit`; written by `$synthesizer`, searched with `$embedder`. Each mark names a stored
snapshot that is never changed; the manifest of the run lists them all. For information only.
""")


def profile_hash(path: str) -> str:
    """The first 16 digits of the SHA-256 of a profile file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:16]


def source_line(r: dict) -> str:
    """One line of evidence: mark, source, tier, title, date, and the start of the content's hash."""
    tier = f", tier {r['tier']}" if r.get("tier") is not None else ""
    when = r.get("published_at")
    return f"- [{r['sid']}] {r['source_id']}{tier}: {r.get('title') or r.get('url') or 'untitled'}; {when.isoformat() if when else 'no date'}; {(r.get('content_hash') or '')[:12]}"


def render(heading: str, profile: Profile, run_id: str, generated_at: datetime, scope: str, body: str, evidence: list[dict], registry_commit: str | None = None, synthesizer: str = "extractive", embedder: str = "hashing-256", layout: str | None = None) -> str:
    """The text of a brief or a report. An unknown field in a layout of one's own is an error. Evidence is
    listed in order of its marks' numbers."""
    lines = "\n".join(source_line(r) for r in sorted(evidence, key=lambda r: int(r["sid"][1:])))
    fields = {"heading": heading, "domain": profile.domain, "run_id": run_id, "generated_at": generated_at.isoformat(timespec="seconds"), "scope": scope, "body": body, "sources": lines, "registry_commit": registry_commit or "uncommitted", "synthesizer": synthesizer, "embedder": embedder}
    return (LAYOUT if layout is None else Template(layout)).substitute(fields)


def manifest_of(run_id: str, workload: str, profile: Profile, result: dict[str, DataFrame], generated_at: datetime, output: str, scope: dict, registry_commit: str | None = None, own_hash: str | None = None, models: dict | None = None, stats: dict | None = None) -> dict:
    """All that a run came from and came to. Evidence and claims of one run are some dozens of rows."""
    rows = lambda df: [json.loads(r.j) for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    evidence, verdicts = rows(result["evidence"].orderBy(F.substring("sid", 2, 20).cast("long"))), rows(result["verdicts"].orderBy("claim_group"))
    checks = result["precision"].first()
    counts: dict[str, int] = {}
    for v in verdicts:
        counts[v["verdict"]] = counts.get(v["verdict"], 0) + 1
    verification = {"checked": checks.checked, "failed": checks.failed, "precision": checks.precision} if checks else {"checked": 0, "failed": 0, "precision": 1.0}
    return {
        "run_id": run_id, "workload": workload, "domain": profile.domain, **scope, "registry_commit": registry_commit, "profile_hash": own_hash, "models": models or {},
        "snapshot_set": sorted({e.get("content_hash") or e.get("chunk_id") for e in evidence}), "evidence": evidence, "claims": verdicts, "verdict_counts": counts,
        "verification": verification, "stats": stats or {}, "output": output, "generated_at": generated_at.isoformat(timespec="seconds"),
    }


class RunLog:
    """Runs as rows that are only appended: the latest row of a run tells its state."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def append(self, **row) -> None:
        names = [c.split()[0] for c in RUN.split(", ")]
        self.spark.createDataFrame([tuple(row.get(c) for c in names)], RUN).write.mode("append").parquet(f"{self.folder}/runs")

    def read(self) -> DataFrame:
        """One row per run, as it was last told."""
        if not exists(self.spark, f"{self.folder}/runs"):
            return self.spark.createDataFrame([], RUN)
        rows = self.spark.read.schema(RUN).parquet(f"{self.folder}/runs")
        others = [c for c in rows.columns if c != "run_id"]
        return rows.groupBy("run_id").agg(F.max_by(F.struct(*others), F.struct(F.col("finished_at").isNotNull(), "finished_at")).alias("r")).select("run_id", "r.*")


def execute(log: RunLog, run_id: str, workload: str, profile: Profile, work: Callable[[], dict[str, DataFrame]], heading: str, scope: dict, clock: Callable[[], datetime] = datetime.now, registry_commit: str | None = None, models: dict | None = None, layout: str | None = None, own_hash: str | None = None) -> dict:
    """Do a run: its text and manifest are written below the log's folder, and the log tells how it went.

    A run that fails is logged as failed with its error, leaves no files under their names, and the error goes on.
    """
    started, base = clock(), f"{log.folder}/{profile.domain}/{run_id}"
    told = {"run_id": run_id, "domain": profile.domain, "workload": workload, "started_at": started, "registry_commit": registry_commit, "models": models or {}}
    log.append(**told, status="running")
    try:
        result = work()
        at = clock()
        body = (result["shipped"].first() or {"shipped": ""})["shipped"]
        evidence = [r.asDict() for r in result["evidence"].toLocalIterator()]
        words = ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in scope.items())
        text = render(heading, profile, run_id, at, words, body, evidence, registry_commit, (models or {}).get("synthesizer", "extractive"), (models or {}).get("embedder", "hashing-256"), layout)
        told_stats = {"stories": len({e.get("story") for e in evidence}), "evidence": len(evidence)}
        m = manifest_of(run_id, workload, profile, result, at, f"{base}.md", scope, registry_commit, own_hash, models, told_stats)
        write_text(log.spark, f"{base}.md", text)
        write_text(log.spark, f"{base}.manifest.json", json.dumps(m, indent=2, ensure_ascii=False))
    except Exception as e:
        log.append(**told, finished_at=clock(), status="failed", error=f"{type(e).__name__}: {str(e)[:500]}")
        raise
    log.append(**told, finished_at=clock(), status="done", manifest_path=f"{base}.manifest.json", output_path=f"{base}.md")
    return m


def saved_evidence(spark: SparkSession, manifest_path: str, schema) -> DataFrame:
    """The evidence of a manifest, in a schema such as the evidence that it was written from."""
    rows = json.loads(read_text(spark, manifest_path))["evidence"]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    return lines.select(F.from_json("j", schema).alias("e")).select("e.*")
