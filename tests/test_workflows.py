import os
import shutil
import subprocess
import sys
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attestry.operators import registry
from attestry.plans import golden, polling, runs, workflows
from attestry.plans.tables import GOLDEN
from attestry.sources.config import Profile
from attestry.storage import written

NOW = datetime(2024, 3, 5, 12)


@pytest.fixture(scope="module")
def world(spark):
    sources = spark.createDataFrame([(g[1], g[1], "rss", "en", "cc", {"general": g[2]}, g[1], "active", ["x"]) for g in GOLDEN] + [("off", "off", "rss", "en", "cc", {"general": 1}, "off", "paused", [])], registry.SCHEMA)
    rows = [(i, f"h{i}:0", f"h{i}", g[1], g[3], g[1], g[4], datetime(2024, 3, 5, i), []) for i, g in enumerate(GOLDEN, 1)]
    rows += [(8, "h8:0", "h8", "city_desk", "c-8", "p", "War risk premiums rose to 0.6 percent on Tuesday across the strait.", datetime(2024, 3, 5, 9), []), (9, "h9:0", "h9", "off", "c-9", "p", "Engineers shut the old railway bridge for repairs after last week's inspection.", datetime(2024, 3, 5, 9), [])]
    chunks = spark.createDataFrame(rows, "id long, chunk_id string, content_hash string, source_id string, cluster_id string, title string, text string, published_at timestamp, entity_ids array<string>")
    return chunks, sources, Profile("d", ["general"])


def test_daily_brief_and_replay(world):
    chunks, sources, profile = world
    out = workflows.daily_brief(chunks, sources, profile, NOW)
    verdicts = {r.text[:20]: r.verdict for r in out["verdicts"].collect()}
    assert verdicts == {"The harbour office c": "confirmed", "Two paper mills in t": "attributed", "Engineers shut the o": "contradicted", "War risk premiums ro": "attributed"}
    assert "off" not in {r.source_id for r in out["evidence"].collect()}
    assert out["precision"].first().precision == 1.0
    shipped = out["shipped"].first()
    assert shipped.n_dropped == 0 and shipped.shipped.count("###") == 4
    again = workflows.replay(written(out["evidence"].withColumn("cluster_id", out["evidence"].story), "saved"), sources, profile, out["verdicts"])
    assert again["difference"].count() == 0


def test_research(world):
    chunks, sources, profile = world
    out = workflows.research("evening ferries cancelled and xyzzy unknown words that match nothing", chunks, sources, profile)
    assert {"harbour_office", "coast_daily"} <= {r.source_id for r in out["evidence"].collect()}
    assert out["verdicts"].filter("verdict = 'confirmed'").count() == 1


def test_runs(spark, world, tmp_path):
    """A brief's files, its manifest, a replay from it, and a run that fails."""
    chunks, sources, profile = world
    log, clock = runs.RunLog(spark, f"file://{tmp_path}"), iter(datetime(2024, 3, 5, 13, i) for i in range(9))
    made = {}

    def work():
        made.update(workflows.daily_brief(chunks, sources, profile, NOW))
        return made

    m = runs.execute(log, "r1", "daily_brief", profile, work, "Daily brief", {"window_hours": 24}, lambda: next(clock), "abc", {"synthesizer": "extractive"})
    assert m["snapshot_set"] == ["h1", "h2", "h3", "h4", "h5", "h8"] and m["verdict_counts"] == {"confirmed": 1, "attributed": 2, "contradicted": 1} and m["verification"]["precision"] == 1.0
    text = (tmp_path / "d" / "r1.md").read_text()
    assert text.startswith("# Daily brief: d\n") and text.count("- [S") == 6 and "window hours 24" in text and "`abc`" in text
    saved = runs.saved_evidence(spark, m["output"].replace(".md", ".manifest.json"), made["evidence"].schema)
    assert workflows.replay(saved.withColumn("cluster_id", saved.story), sources, profile, made["verdicts"])["difference"].count() == 0

    def broken():
        raise OSError("no space")

    with pytest.raises(OSError):
        runs.execute(log, "r2", "daily_brief", profile, broken, "Daily brief", {}, lambda: next(clock))
    assert {r.run_id: r.status for r in log.read().collect()} == {"r1": "done", "r2": "failed"} and not (tmp_path / "d" / "r2.md").exists()
    with pytest.raises(KeyError):
        runs.render("x", profile, "r", NOW, "", "", [], layout="$unknown")


def test_seams(spark, world):
    """Stages that stand in for the engine's own."""
    chunks, sources, profile = world
    seen = []

    def match(claims):
        seen.append("match")
        return claims.select("id", F.lit(1).cast("long").alias("root"))

    seams = workflows.Seams(match=match, plan=lambda q: ["ferries"], reflect=lambda parts: parts.select("text", F.lit("islands").alias("again")), discover=lambda urls: urls.select(F.lit(1).alias("ord"), "url", F.lit("t").alias("title")))
    out = workflows.research("anything", chunks, sources, profile, seams=seams)
    assert seen and out["verdicts"].filter("claim_type = 'event'").count() == 1 and seams.models["embedder"] == "hashing-256"
    urls = spark.createDataFrame([("http://new.org/x",)], "url string")
    assert [r.netloc for r in workflows.propose_sources(urls, spark.createDataFrame([], "url string"), seams=seams).collect()] == ["new.org"]
    with pytest.raises(ValueError):
        workflows.propose_sources(urls, urls)


GOLDEN_CASES = """
targets: {expectation_pass_rate: 1.0, citation_precision: 0.9}
cases:
  - name: ferries
    docs:
      - {source_id: harbour_office, tier: 1, text: The harbour office cancelled all evening ferries to the islands because of thick fog.}
      - {source_id: coast_daily, tier: 2, text: "The harbour office cancelled all evening ferries to the islands, the pilots said."}
    expect:
      - {claim_contains: EVENING FERRIES, verdict: confirmed}
      - {claim_contains: evening ferries, verdict: confirmed, claim_type: event}
  - name: mills
    docs:
      - {source_id: valley_news, tier: 2, text: Two paper mills in the valley plan to share one water treatment plant from next spring.}
    expect:
      - {claim_contains: paper mills, verdict: attributed}
      - {claim_contains: no such thing, verdict: attributed}
"""


def test_golden_harness(spark, tmp_path):
    (tmp_path / "cases.yaml").write_text(GOLDEN_CASES)
    out = golden.run_golden(spark, Profile("d", ["general"]), str(tmp_path / "cases.yaml"))
    r = out["report"].first()
    assert (r.expectation_pass_rate, r.citation_precision, r.ok) == (0.75, 1.0, False)
    assert {(x.case, x.needle): x.passed for x in out["outcomes"].collect()} == {("ferries", "EVENING FERRIES"): True, ("ferries", "evening ferries"): True, ("mills", "paper mills"): True, ("mills", "no such thing"): False}


def test_poll_loop(spark, tmp_path):
    sources = spark.createDataFrame([(i, i, "x", "en", "cc", {"general": t}, i, s, ["e"]) for i, t, s in (("a", 1, "active"), ("b", 1, "active"), ("c", 1, "active"), ("off", 1, "paused"), ("low", 3, "active"))], registry.SCHEMA)
    profile, store = Profile("d", ["general"], 2), polling.Store(spark, f"file://{tmp_path}/store")
    ticks, asked = iter(datetime(2024, 1, 1, 0, i) for i in range(60)), []

    def read(spark, source, after):
        asked.append((source["source_id"], after))
        if source["source_id"] == "b":
            raise OSError("down")
        return spark.createDataFrame([("u", "t", b"same", "text/plain", None), ("v", "t", source["source_id"].encode(), "text/plain", None)], "url string, title string, content binary, media_type string, published_at timestamp")

    run = lambda **k: polling.poll(store, sources, profile, read, clock=lambda: next(ticks), **k)
    dry = run(dry_run=True)
    assert [r["status"] for r in dry] == ["skipped_dry_run", "error", "skipped_dry_run"] and store.events.count() == 0 == store.snapshots.count()
    first = run()
    assert [(r["source_id"], r["status"], r["snapshots_new"], r["snapshots_dup"]) for r in first] == [("a", "ok", 2, 0), ("b", "error", 0, 0), ("c", "ok", 1, 1)] and polling.totals(first) == (4, 3, 1)
    asked.clear()
    assert [r["snapshots_new"] for r in run(only_source="a")] == [0] and asked == [("a", datetime(2024, 1, 1, 0, 3))]
    asked.clear()
    run()
    assert dict(asked)["b"] is None and "no answer" not in str(first) and store.events.filter("status = 'error'").first().error == "OSError: down"
    for bad in ("off", "low", "nobody"):
        with pytest.raises(KeyError):
            run(only_source=bad)


def test_registry_commit(tmp_path):
    assert polling.registry_commit(str(tmp_path / "r.yaml")) is None
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "r.yaml").write_text("a")
    git("add", ".")
    git("commit", "-qm", "x")
    clean = polling.registry_commit(str(tmp_path / "r.yaml"))
    (tmp_path / "r.yaml").write_text("b")
    assert len(clean) >= 7 and polling.registry_commit(str(tmp_path / "r.yaml")) == clean + "-dirty"


def test_plan():
    assert workflows.plan("a b and c?") == ["a b", "c"] and workflows.plan(" one? ") == ["one?"]


def test_the_rest_does_without_the_corpus_operators(tmp_path):
    """A copy without the corpus folders and pipeline still imports and lists its queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "attestry"), tmp_path / "attestry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'build_stories' in e.queries() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
