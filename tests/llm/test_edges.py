"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for each operator."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from attestry.llm import boilerplate, decontamination, merkle, mixing, sharding, simhash, suffixes, token_counts, toxicity, warc
from attestry.llm.queries import tokenizer_path
from attestry.storage import work_path

from .conftest import EDGES, LONG


def test_simhash(edges, nothing):
    out = simhash.near_duplicates(edges).select("row.doc_id", "row.text", "row.size", "fp", "component_id").collect()
    assert len(out) == len(EDGES) and all(r["size"] == 7 for r in out)
    fox = [r.component_id for r in out if r.text and r.text.startswith("The quick")]
    assert fox == [1, 1, 1]
    assert {r.component_id for r in out if not (r.text or "").split()} == {2}
    assert simhash.near_duplicates(nothing).count() == 0


def test_keep_one(edges, nothing):
    out = simhash.keep_one(edges)
    assert out.columns == edges.columns
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    # one of the repeated rows and their copy without an id, one of the wordless ones
    assert ids == [1, 2, 4, 5, 6]
    assert simhash.keep_one(nothing).count() == 0


def test_mixing(edges, nothing):
    out = mixing.mix(edges)
    got = out.select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(EDGES)
    for r in got:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.taken <= 2 * r["size"] and r.taken == r["size"] * (r.copies if r["size"] else 0)
        assert r.target <= 2 * r.source_size + 1e-9
    assert {r.copies for r in got if not r["size"]} == {1}
    assert mixing.expand(out).columns == edges.columns
    assert mixing.mix(nothing).count() == 0 and mixing.expand(mixing.mix(nothing)).count() == 0


def test_sharding(edges, nothing):
    out = sharding.kd_shards(edges, 3).select("row.doc_id", "size", "shard", "slot", "row.shard").collect()
    assert len(out) == len(EDGES)
    for s in {r[2] for r in out}:
        assert sorted(r.slot for r in out if r[2] == s) == list(range(sum(r[2] == s for r in out)))
    assert all(0 <= r[2] < 3 for r in out) and {r["size"] for r in out if r.doc_id in (2, 3)} == {1}
    assert sharding.kd_shards(nothing).count() == 0
    assert {r.shard for r in sharding.kd_shards(edges, None, 1 << 40).select("shard").collect()} == {0}


def test_decontamination(edges, nothing, bench, spark):
    assert decontamination.leaks(edges, bench).count() == 0
    assert decontamination.decontaminate(edges, bench).count() == len(EDGES)
    assert decontamination.decontaminate(edges, bench).columns == edges.columns
    assert decontamination.leaks(nothing, bench).count() == 0
    assert decontamination.leaks(edges, bench.limit(0)).count() == 0
    assert decontamination.leaks(edges, spark.createDataFrame([(9, EDGES[0][1])], "item_id long, text string")).select("doc_id", "item_id").distinct().count() == 2


def test_token_counts(edges, nothing):
    path = tokenizer_path()
    out = token_counts.count_tokens(edges, path).collect()
    assert len(out) == len(EDGES)
    assert {r.n_tokens for r in out if not r.n_bytes} == {0}
    assert next(r.n_tokens for r in out if r.n_bytes == len(LONG)) == token_counts._pieces(path, [LONG])[0]
    assert token_counts.count_tokens(nothing, path).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(edges, path, pattern=r"\w+|\W+")


def test_warc(spark):
    spec = "page_id long, url string, html string, key string, p long, sha1 string, shard int"
    rows = [(1, "http://a/\r\nx", "<p>é</p>", "k", 7, "x", 7), (1, "http://a/", "<p>é</p>", "k", 7, "x", 7), (2, None, None, "k", 7, "x", 7), (3, "http://b", "", "k", 7, "x", 7), (None, "http://c", "<p>é</p>", "k", 7, "x", 7), (0, "http://l", LONG, "k", 7, "x", 7)]
    folder = work_path(spark, "warc")
    manifest = warc.write_archives(spark.createDataFrame(rows, spec), folder)
    out = warc.read_archives(spark, folder).collect()
    assert len(out) == 6 and sum(r.records for r in manifest.collect()) == 6
    kinds = sorted((r.page_id, r.record_type, r.refers_to) for r in out)
    assert kinds == [(0, "response", None), (1, "response", None), (1, "revisit", 1), (2, "response", None), (3, "revisit", 2), ((1 << 63) - 1, "revisit", 1)]
    empty = work_path(spark, "warc")
    assert warc.write_archives(spark.createDataFrame([], spec), empty).count() == 0
    assert warc.read_archives(spark, empty).count() == 0


def test_suffixes(edges, nothing):
    out = suffixes.remove_repeats(edges).collect()
    assert len(out) == len(EDGES)
    fox = EDGES[0][1].encode()
    got = sorted(((r.doc_id is None, r.n_removed) for r in out if r.n_bytes == len(fox)))
    assert got == [(False, 0), (False, 0), (True, len(fox))]
    assert {(r.n_removed, r.n_spans) for r in out if r.n_bytes < 50} == {(0, 0)}
    assert suffixes.remove_repeats(nothing).count() == 0


def test_boilerplate_of_large_hosts(spark, monkeypatch):
    """Lines that are joined by host and part are the same as those that are broadcast."""
    rows = [(i, f"http://{'ab'[i % 5 == 0]}.com/{i}" if i % 11 else None, f"<p>Menu</p><p>Text {i}</p><p>About {i % 3}</p>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = lambda: sorted((r.page_id, r.host, r.lines, r.kept) for r in boilerplate.strip_boilerplate(pages).select("row.page_id", "host", "lines", "kept").collect())
    want = read()
    monkeypatch.setattr(boilerplate, "BROADCAST_LINES", 0)
    monkeypatch.setattr(boilerplate, "PART", 7)
    assert read() == want and len(want) == 60 and any(len(r[3]) < 3 for r in want)


def test_boilerplate(spark):
    spec = "page_id long, url string, html string, host string, lines string, kept string, row string, count int"
    page = lambda i, u, h: (i, u, h, "h", "l", "k", "r", 7)
    rows = [page(i, "http://a.com/x", f"<p>Menu</p><p>Text {i}</p><p>Menu</p>") for i in range(4)] + [page(9, None, "<p>Menu</p>"), page(10, "http://b.com", None), page(None, "HTTP://A.com", "<p>Menu</p>"), page(11, "http://c.com", "<p>" + LONG)]
    out = {(r.page_id, r.host): (r.lines, r.kept) for r in boilerplate.strip_boilerplate(spark.createDataFrame(rows, spec)).select("row.page_id", "host", "lines", "kept").collect()}
    assert out[0, "a.com"] == (["Menu", "Text 0", "Menu"], ["Text 0"])
    assert out[9, ""] == (["Menu"], ["Menu"]) and out[10, "b.com"] == ([], []) and out[None, "a.com"][1] == [] and out[11, "c.com"][1] == [LONG]
    assert boilerplate.strip_boilerplate(spark.createDataFrame([], spec)).count() == 0


def test_toxicity(edges, nothing, spark):
    labels = spark.createDataFrame([(1, 1, None), (4, 1, 1), (5, 0, 0), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score(edges, toxicity.train(edges, labels)).collect()
    assert len(out) == len(EDGES) and all(0 <= r.toxicity <= 1 for r in out)
    none = toxicity.train(edges, labels.limit(0))
    assert {r.toxicity < 0.5 for r in toxicity.score(edges, none).collect()} == {True}
    assert toxicity.score(nothing, none).count() == 0


def test_merkle(edges, nothing):
    out = merkle.with_next(edges).collect()
    assert len(out) == len(EDGES)
    order = sorted(EDGES, key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted(r.text for r in out) == sorted(r.next_text for r in out) == sorted(r[1] or "" for r in order)
    assert len({r.fingerprint for r in out if not r.text}) == 1
    assert merkle.with_next(nothing).count() == 0
    one = merkle.with_next(edges.filter("doc_id = 4")).first()
    assert one.next_text == one.text and one.next_fingerprint == one.fingerprint


@pytest.fixture
def tables(spark, bench, tmp_path):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, edges, nothing, tables, name, stage):
    out = stage(spark, edges, tables)
    assert sorted(out.columns) == sorted({*edges.columns, *(("slot",) if name == "sharding" else ())})
    assert out.count() > 0
    assert stage(spark, nothing, tables).count() == 0


def test_differing_branches(spark):
    df = spark.createDataFrame([("a\nb\n\nc", "a\nx\n\nc"), ("a", "a"), ("a\n\nb", "a\n\nb\n\nc")], "x string, y string")
    got = df.select(merkle.differing(merkle.fingerprint(F.col("x")), merkle.fingerprint(F.col("y"))).alias("z")).collect()
    assert [[tuple(b) for b in r.z] for r in got] == [[("a", 0, 1), ("b", 0, 1)], [], [("a", 1, 0), ("b", 1, 0), ("b", 2, 0)]]
