"""Substring search, streams of signatures and polls, commit logs, inverted files."""

import random
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry import storage
from attestry.commits import Log
from attestry.operators import ivf, observe, signatures, snapshots, substrings, vector_index
from attestry.operators.retrieve import dense_topk
from attestry.streaming import bands, streams


def test_substrings(spark):
    """All lengths of needles, scripts, repeats inside a text, blocks of a long text, several keys."""
    r = random.Random(4)
    alphabets = ["ab", "abcdefghij klmnop", "日本語の文字", "éàü ж я", "\U0001f600\U0001f602a "]
    texts = [(i, r.choice(["k1", "k2", None]), "".join(r.choice(a) for _ in range(r.choice([0, 1, 3, 9, 60, 700, 2500])))) for i, a in enumerate(alphabets * 30)]
    texts += [(900 + i, "k1", "x" * 300 + str(i)) for i in range(20)] + [(990, "k2", None)]
    needles = []
    for i in range(300):
        _, key, text = r.choice([t for t in texts if t[2]])
        at, n = r.randrange(len(text)), r.choice([1, 2, 3, 5, 8, 12, 100, 250, 1700])
        needles.append((i, r.choice([key, "k1", "k2", None]), text[at : at + n] if r.random() < 0.8 else text[at : at + n] + "q"))
    needles += [(1000, "k1", "x" * 250), (1001, "k1", ""), (1002, "k2", None), (1003, "k1", "x" * 299 + "1")]
    schema = "id long, key string, text string"
    got = substrings.occurrences(spark.createDataFrame(needles, schema), spark.createDataFrame(texts, schema).repartition(5))
    want = {(n, t) for n, k, needle in needles for t, key, text in texts if needle and text is not None and k is not None and k == key and needle in text}
    pairs = [tuple(x) for x in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want) and len({n for n, _ in want}) > 100
    none = spark.createDataFrame([], schema)
    assert substrings.occurrences(none, none).collect() == [] and substrings.occurrences(spark.createDataFrame(needles, schema), none).collect() == []


def test_needles_send_no_texts(spark):
    """What is joined before the end is ids, places and hashes; no text is broadcast."""
    claims = [("c", f"Claim number {i} says that the {w} is closed", "event", "confirmed") for i, w in enumerate(["port", "mill", "road"] * 50)]
    wanted = [("c", "THE PORT", None, "confirmed"), ("c", "a", "event", "confirmed"), ("c", "", None, "attributed"), ("c", "gone", None, "confirmed"), ("d", "port", None, "confirmed"), (None, "port", None, "confirmed"), ("c", None, None, "confirmed")]
    made = observe.golden_outcomes(spark.createDataFrame(wanted, "case string, needle string, claim_type string, verdict string"), spark.createDataFrame(claims, "case string, text string, claim_type string, verdict string"))
    got = {(x.case, x.needle): (x.passed, x.got) for x in made.collect()}
    assert got[("c", "THE PORT")] == (True, ["confirmed"]) and got[("c", "a")] == (True, ["confirmed"]) and got[("c", "")] == (False, ["confirmed"])
    assert all(got[k] == (False, []) for k in (("c", "gone"), ("d", "port"), (None, "port"), ("c", None)))
    assert "Contains" not in made._jdf.queryExecution().toString()


def story(topic, n, changed=()):
    return " ".join(f"new{w}" if w in changed else f"{topic}{w}" for w in range(n))


DAY = timedelta(days=1)
START = datetime(2024, 1, 1)


def arrivals():
    """(name, text, created_at): groups of near copies, some of them too far apart in time, and singles."""
    out = []
    for g in range(6):
        for i in range(5):
            out.append((f"g{g}-{i}", story(f"t{g}w", 120, {3 * i} if i else ()), START + g * DAY + i * (5 if g % 2 else 1) * DAY))
    out += [("far-0", story("f", 120), START), ("far-1", story("f", 120, {7}), START + 20 * DAY), ("empty", "", START + DAY)]
    return out


def named(spark, rows, store):
    docs = spark.createDataFrame([(n, t) for n, _, t in rows], "content_hash string, created_at timestamp")
    return {frozenset(r.n) for r in bands.clusters(docs, store).groupBy("cluster_id").agg(F.collect_set("content_hash").alias("n")).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_signature_stream_in_any_batches(spark, tmp_path, seed):
    """Files in another order, one batch each and restarts in between, give the answer of one batch."""
    rows = arrivals()
    schema = "content_hash string, text string, created_at timestamp"
    table = spark.createDataFrame(rows, schema)
    links = signatures.band_links(signatures.signatures(table))
    links.write.parquet(f"{tmp_path}/all/batch=0")
    want = named(spark, rows, f"{tmp_path}/all")
    assert frozenset({"far-0"}) in want and frozenset(f"g0-{i}" for i in range(5)) in want and len(want) < len(rows) - 15
    order = rows[:]
    random.Random(seed).shuffle(order)
    for k, part in enumerate((order[:9], order[9:10], order[10:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        bands.link_stream(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint", late="60 days")
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False
    assert named(spark, rows, f"{tmp_path}/store") == want


def test_signature_stream_forgets(spark, tmp_path):
    """A member that nothing after the watermark can meet leaves the state, and rows behind the watermark take no part."""
    schema = "content_hash string, text string, created_at timestamp"

    def run(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        bands.link_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/checkpoint", late="1 day")
        return spark.read.schema("a string, b string").parquet(f"{tmp_path}/store").distinct().count()

    a = story("a", 100)
    assert run(("a0", a, START)) == 0
    assert run(("a1", story("a", 100, {1}), START + 3 * DAY)) == 1
    assert run(("b0", story("b", 100), START + 40 * DAY)) == 1
    # behind the watermark of day 39
    assert run(("a2", story("a", 100, {2}), START + 4 * DAY)) == 1
    state = spark.read.format("statestore").option("stateVarName", "bands").load(f"{tmp_path}/checkpoint")
    held = {n for r in state.select("user_map_value.names").collect() for n in r.names.split("\n")}
    assert held == {"b0"}


def test_links_through_any_member_of_a_band(spark):
    """Two that agree with each other but not with the first of their band are joined; crowded bands are split."""
    base = [random.Random(i).randrange(1 << 31) for i in range(128)]
    other = [x + 1 if i >= 4 else x for i, x in enumerate(base)]
    near = [x + (i == 100) for i, x in enumerate(other)]
    rows = [("first", base, START), ("b", other, START + DAY), ("c", near, START + 2 * DAY), ("late", near, START + 30 * DAY), ("none", None, START)]
    signed = spark.createDataFrame(rows, "content_hash string, signature array<long>, created_at timestamp")
    assert [tuple(r) for r in signatures.band_links(signed).collect()] == [("b", "c")]
    empty = spark.createDataFrame([], "content_hash string, signature array<long>, created_at timestamp, cluster_id string")
    got = {r.content_hash: r.cluster_id for r in signatures.assign(signed, empty).collect()}
    assert got == {"first": "first", "b": "b", "c": "b", "late": "b", "none": "none"}


def test_crowded_bands(spark, monkeypatch):
    monkeypatch.setattr(signatures, "HOT_BAND", 5)
    sign = [7] * 128
    rows = [(f"n{i:02}", [*sign[:120], *([i] * 8)], START) for i in range(23)]
    links = signatures.band_links(spark.createDataFrame(rows, "content_hash string, signature array<long>, created_at timestamp"))
    from attestry.operators.graph import components

    assert {r.root for r in components(links).collect()} == {"n00"} and components(links).count() == 23


def test_stream_of_clusters_runs_again(spark, tmp_path):
    """The store of one batch written twice is the same, whatever the clock says."""
    schema = "content_hash string, text string, created_at timestamp"
    spark.createDataFrame(arrivals(), schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    for n in (1, 2):
        streams.cluster_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/s{n}", f"{tmp_path}/c{n}")
    one, two = ({(r.content_hash, r.cluster_id) for r in spark.read.parquet(f"{tmp_path}/s{n}").select("content_hash", "cluster_id").collect()} for n in (1, 2))
    assert one == two and ("g0-3", "g0-0") in one and ("far-1", "far-0") in one


def test_log_numbers_are_taken_once(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/t")
    assert log.entries() == [] and log.commit(1, {"a": 1}) and not log.commit(1, {"a": 2}) and log.append({"b": 1}) == 2
    assert [e["version"] for e in log.entries()] == [1, 2] and log.commit(3, {"base": True}) and log.append({"c": 1}) == 4
    assert [e["version"] for e in log.entries()] == [3, 4]
    taken = []
    threads = [threading.Thread(target=lambda: taken.append(log.append({}))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(taken) == [5, 6, 7, 8] and not [n for n in storage.names(spark, f"file://{tmp_path}/t/_log") if "json." in n]


def test_readers_never_miss_a_text_that_is_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/x.json"
    storage.write_text(spark, path, "0")
    seen, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            seen.append((tmp_path / "x.json").read_text())

    t = threading.Thread(target=watch)
    t.start()
    for i in range(1, 40):
        storage.write_text(spark, path, str(i))
    stop.set()
    t.join()
    assert storage.read_text(spark, path) == "39" and [int(x) for x in seen] == sorted(int(x) for x in seen)


def test_blobs_of_writers_at_one_time(spark, tmp_path):
    """Two writers with common contents, and files of one that died: each hash once."""
    folder = f"file://{tmp_path}/blobs"
    made = lambda ids: spark.createDataFrame([(f"{i % 7:02}{i}", f"text {i}".encode()) for i in ids], "content_hash string, content binary")
    counts, threads = [], []
    for ids in (range(60), range(30, 90), range(0, 90, 2)):
        threads.append(threading.Thread(target=lambda ids=ids: counts.append(snapshots.write_blobs(made(ids), folder))))
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    made([500]).withColumn("blob_uri", F.lit("x")).withColumn("shard", F.lit("00")).write.partitionBy("shard").parquet(f"{folder}/part=dead")
    got = [r.content_hash for r in snapshots.read_blobs(spark, folder).collect()]
    assert sorted(got) == sorted(f"{i % 7:02}{i}" for i in range(90)) and sum(counts) == 90
    assert snapshots.write_blobs(made([500]), folder) == 1 and snapshots.write_blobs(made([500]), folder) == 0
    assert snapshots.vacuum_blobs(spark, folder) == [] and snapshots.vacuum_blobs(spark, folder, 0) == ["part=dead"]
    assert snapshots.read_blobs(spark, folder).count() == 91


def test_upserts_write_what_is_new(spark, tmp_path):
    one = vector_index.VectorIndex(spark, f"file://{tmp_path}/index")
    one.ensure(2, "e")
    points = lambda ids, label: spark.createDataFrame([(str(i), [float(i), 1.0], label) for i in ids], "id string, vector array<double>, label string")
    assert one.upsert(points(range(1000), "a")) == 1000
    assert [one.upsert(points(range(10 * n, 10 * n + 10), f"b{n}")) for n in (1, 2)] == [10, 10] and one.upsert(points([15, 2000], "c")) == 2
    held = lambda: {int(r.id): r.label for r in one.read().collect()}
    want = {i: "a" for i in range(1000)} | {i: "b1" for i in range(10, 20)} | {i: "b2" for i in range(20, 30)} | {15: "c", 2000: "c"}
    assert held() == want and one.read().count() == len(want) and not one.compact()
    # a fifth of the points are later ones: all are written as one part
    one.upsert(points(range(300, 500), "d"))
    want |= {i: "d" for i in range(300, 500)}
    entries = one.log.entries()
    assert held() == want and len(entries) == 1 and entries[0]["rows"] == len(want)
    assert one.vacuum() == [] and len(one.vacuum(0)) == 5 and held() == want and one.vacuum(0) == []
    # an upsert during a compaction makes that one void
    one.upsert(points([1], "e"))
    write = one._write

    def late(rows):
        out = write(rows)
        one._write = write
        one.upsert(points([2], "f"))
        return out

    one._write = late
    assert one.compact(force=True) is False and held() == want | {1: "e", 2: "f"}
    one.ensure(2, "e")
    with pytest.raises(vector_index.IndexMismatch):
        one.ensure(2, "other")


def test_upserts_at_one_time(spark, tmp_path):
    one = vector_index.VectorIndex(spark, f"file://{tmp_path}/index")
    one.ensure(1, "e")
    threads = [threading.Thread(target=lambda k=k: one.upsert(spark.createDataFrame([(f"{k}-{i}", [1.0]) for i in range(5)], "id string, vector array<double>"))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert one.read().count() == 20


def test_inverted_file(spark, monkeypatch):
    """Clustered vectors with a frequent one: recall of 0.9 in a few lists, all lists are exact, crowded cells are dealt."""
    monkeypatch.setattr(ivf, "ROWS", 150)
    monkeypatch.setattr(ivf, "QUERIES", 9)
    r = np.random.default_rng(3)
    centres = r.normal(size=(25, 12))
    data = [(i, (centres[i % 25] + 0.35 * r.normal(size=12)).tolist()) for i in range(1500)] + [(2000 + i, centres[0].tolist()) for i in range(300)]
    data += [(5000, None), (5001, [0.0] * 12)]
    vectors = spark.createDataFrame(data, "id long, vector array<double>").repartition(4)
    queries = vectors.filter("id % 20 = 0 AND vector IS NOT NULL").withColumnRenamed("id", "query_id")
    known = vectors.filter("vector IS NOT NULL")
    exact = dense_topk(queries, known, 10).cache()
    file = ivf.calibrated(ivf.build(vectors), known, queries.filter("query_id % 100 = 0"), 10, 0.95)
    found = ivf.search(file, queries, 10)
    assert ivf.recall(found, exact) >= 0.9 and file.probes < len(file.centroids) / 3
    from dataclasses import replace

    whole = ivf.search(replace(file, probes=len(file.centroids)), queries, 10)
    assert {tuple(x) for x in whole.select("query_id", "id", "rank").collect()} == {tuple(x) for x in exact.select("query_id", "id", "rank").collect()}
    none = ivf.build(vectors.limit(0))
    assert ivf.search(none, queries, 10).count() == 0 and ivf.search(file, queries.limit(0), 10).count() == 0


def test_streaks_equal_the_batch_after_every_batch(spark, tmp_path):
    from attestry.streaming import streaks

    r = random.Random(8)
    schema = "source_id string, event_id long, started_at timestamp, status string, error string"
    rows = []
    for day in range(12):
        for k in range(12):
            bad = r.random() < 0.6
            rows.append((f"s{k % 3}", len(rows), START + day * DAY + timedelta(minutes=r.randrange(1440)), "error" if bad else r.choice(["ok", "not_modified"]), r.choice([None, "", "broken"]) if bad else None))
    rows.append(("silent", 9999, START, "error", "x"))
    store, seen = f"{tmp_path}/store", []
    for at in range(0, len(rows), 36):
        part = rows[at : at + 36]
        r.shuffle(part)
        seen += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streaks.streak_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/checkpoint", "20 days")
        polls = spark.createDataFrame(seen, schema).withColumns({"items_seen": F.lit(0), "snapshots_new": F.lit(0)})
        columns = ["source_id", "status", "last_status", "last_ok_at", "consecutive_failures", "last_error"]
        want = observe.source_health(polls, polls.select("source_id").distinct(), START).select(*columns)
        assert sorted(map(tuple, streaks.latest(spark, store).select(*columns).collect())) == sorted(map(tuple, want.collect()))


def test_settled_failures_are_counted(spark, tmp_path):
    """With a short watermark the state holds a number for old failures; a good poll takes them all away."""
    from attestry.streaming import streaks

    schema, n = "source_id string, event_id long, started_at timestamp, status string, error string", iter(range(1000))

    def run(*polls):
        spark.createDataFrame([("s", next(n), START + d * DAY, status, None) for d, status in polls], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streaks.streak_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/checkpoint", "1 hour")
        return streaks.latest(spark, f"{tmp_path}/store").first()["consecutive_failures"]

    assert run((0, "ok"), (1, "error"), (2, "error")) == 2
    assert run((5, "error")) == 3
    assert run((6, "error"), (1.5, "ok")) == 4  # a good poll behind the watermark is too late
    assert run((7, "error"), (6.99, "ok")) == 1


def plain_chunks(text, size, overlap):
    """Split, then put together, in plain steps."""

    def together(parts):
        out, held = [], []
        for p in parts:
            if held and sum(map(len, held)) + len(p) > size:
                out.append("".join(held).strip())
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held.pop(0)
            held.append(p)
        return [*out, "".join(held).strip()]

    def split(t, marks):
        while marks and marks[0] not in t:
            marks = marks[1:]
        if marks:
            first, *rest = t.split(marks[0])
            parts = [p for p in [first, *(marks[0] + r for r in rest)] if p]
        else:
            parts = list(t)
        out, run = [], []
        for p in parts:
            if len(p) < size:
                run.append(p)
                continue
            out += [*(together(run) if run else []), *split(p, marks[1:])]
            run = []
        return out + (together(run) if run else [])

    return [c for c in split(text, ["\n\n", "\n", " "]) if c] or [text]


def test_recursive_chunks(spark):
    from attestry.operators.chunking import recursive_chunks

    r = random.Random(6)
    texts = ["", " \n ", "one", "x" * 95, "é" * 21 + " b", "a" * 10, "a\n\n\n\nb" * 9, "\n\n" + "w " * 40, "\x85 " + "z" * 30 + " "]
    for _ in range(150):
        texts.append("".join(r.choice([r.choice(["ab", "word", "\U0001f600", "日本"]) * r.randrange(1, 9), " ", "\n", "\n\n", "  ", "\t"]) for _ in range(r.randrange(1, 60))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    for size, overlap in ((10, 3), (40, 12), (25, 0)):
        got = {x.i: x.c for x in df.select("i", recursive_chunks(F.col("t"), size, overlap).alias("c")).collect()}
        assert got.pop(-1) == [""]
        for i, t in enumerate(texts):
            assert got[i] == plain_chunks(t, size, overlap), (size, overlap, t)
    assert "Python" not in df.select(recursive_chunks(F.col("t")))._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [4096, 20])
def test_pruned_search_equals_the_whole_one(spark, monkeypatch, block):
    """Frequent and rare terms with ties; fewer postings are scored, and hot terms are split."""
    from attestry.operators import block_max
    from attestry.operators.retrieve import sparse_topk

    monkeypatch.setattr(block_max, "BLOCK", block)
    r = random.Random(9)
    docs = {i: {t for t in range(6) if r.random() < 0.7} | {r.randrange(6, 40) for _ in range(3)} | {r.randrange(40, 2000) for _ in range(4)} for i in range(1500)}
    post = [(i, t, r.choice([0.4, 0.9, 1.3, 2.1])) for i, ts in docs.items() for t in sorted(ts)]
    asked = [(q, t, 1.0) for q in range(30) for t in sorted(docs[q * 7])] + [(99, 1, 1.0), (100, 5000, 1.0), (101, 1999, 2.0)]
    postings = spark.createDataFrame(post, "id long, idx long, weight double")
    queries = spark.createDataFrame(asked, "query_id long, idx long, weight double")
    for k in (3, 10):
        want = sorted(map(tuple, sparse_topk(queries, postings, len(docs), k).select("query_id", "id", "score", "rank").collect()))
        hits = block_max.search(queries, block_max.build(postings, len(docs)), k)
        assert sorted(map(tuple, hits.rows.select("query_id", "id", "score", "rank").collect())) == want
        assert hits.scored < hits.all / 2
    none = block_max.search(queries.limit(0), block_max.build(postings, len(docs)), 3)
    assert none.rows.count() == 0 and (none.scored, none.all) == (0, 0)
    assert block_max.search(queries, block_max.build(postings.limit(0), 0), 3).rows.count() == 0


def greedy(order, edges):
    near, out = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for n in order:
        before = [x for x in order if x in out and x in near.get(n, ())]
        out[n] = out[before[0]] if before else n
    return out


@pytest.mark.parametrize("cuts", [(), (7, 20), (1, 2, 3, 30)])
def test_clusters_by_batches(spark, tmp_path, cuts):
    """A chain, a star and random edges: any split of the order gives what the plain walk gives, and merging is asked for."""
    from attestry.operators.component_index import ComponentIndex

    r = random.Random(12)
    order = [f"n{r.randrange(10**6):06}-{i}" for i in range(40)]
    edges = {(order[i], order[i + 1]) for i in range(10)} | {(order[12], order[k]) for k in range(20, 28)} | {tuple(r.sample(order, 2)) for _ in range(14)}
    index = ComponentIndex(spark, f"file://{tmp_path}/index")
    assert index.clusters() is None and index.merge(spark.createDataFrame([], "a string, b string")) == 0
    for first, last in zip((0, *cuts), (*cuts, len(order)), strict=True):
        batch = order[first:last]
        seen = set(order[:last])
        own = [e for e in edges if e[0] in seen and e[1] in seen]
        nodes = spark.createDataFrame([(n, order.index(n)) for n in batch], "node string, at int")
        index.add(nodes, spark.createDataFrame(own, "a string, b string"))
    held = lambda: {x.node: x.cluster for x in index.clusters().collect()}
    want = greedy(order, edges)
    assert held() == want and index.clusters().count() == len(order) and len(set(want.values())) > 3
    # stored nodes keep their cluster, whatever comes
    index.add(spark.createDataFrame([(order[3], 0)], "node string, at int"), spark.createDataFrame([(order[0], order[39])], "a string, b string"))
    assert held() == want
    merged = list(edges)
    assert index.merge(spark.createDataFrame(merged[: len(merged) // 2], "a string, b string")) >= 1
    index.merge(spark.createDataFrame(merged, "a string, b string"))
    root = {n: n for n in order}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)), key=order.index)
        root[y] = x
    assert held() == {n: find(n) for n in order}
    assert index.merge(spark.createDataFrame(merged, "a string, b string")) == 0


def undone(checkpoint):
    """Forget that the last batch was done, as a driver that dies before it could say so."""
    last = max(int(f.name) for f in (checkpoint / "commits").iterdir() if f.name.isdigit())
    for f in (checkpoint / "commits").iterdir():
        if f.name.strip(".").split(".")[0] == str(last):
            f.unlink()
    return last


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """put_stream and link_stream: the last batch is done twice, then more comes."""
    schema = "content_hash string, source_id string, fetched_at long, ord long"
    put = lambda: streams.put_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/checkpoint")
    held = lambda: sorted(map(tuple, streams.read_store(spark, f"{tmp_path}/store", spark.createDataFrame([], schema).schema).collect()))
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add([("a", "s1", 1, 1), ("a", "s2", 2, 2), ("b", "s1", 3, 3)])
    put()
    add([("b", "s0", 0, 0), ("c", "s1", 4, 4)])
    put()
    want = held()
    assert want == [("a", "s1", 1, 1), ("b", "s1", 3, 3), ("c", "s1", 4, 4)]
    assert undone(tmp_path / "checkpoint") == 1
    put()
    assert held() == want
    add([("c", "s9", 9, 9), ("d", "s9", 9, 9)])
    put()
    assert held() == [*want, ("d", "s9", 9, 9)]

    docs = "content_hash string, text string, created_at timestamp"
    stories = arrivals()
    link = lambda: bands.link_stream(spark.readStream.schema(docs).parquet(f"{tmp_path}/docs"), f"{tmp_path}/links", f"{tmp_path}/marks", late="60 days")
    links = lambda: sorted(map(tuple, spark.read.schema("a string, b string").parquet(f"{tmp_path}/links").collect()))
    for part in (stories[::2], stories[1::2]):
        spark.createDataFrame(part, docs).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
        link()
    want = links()
    undone(tmp_path / "marks")
    link()
    assert links() == want and len(want) > 10


def test_claim_ids_of_long_texts(spark):
    """1,200 lines, and 120 sentences in a line: no two places of three texts share an id, and ids follow the order."""
    from attestry.operators import claims

    text = "\n".join(f"This is the line number {i} of a long report." for i in range(1200)) + "\n" + " ".join(f"Sentence number {i} of the last line is here." for i in range(120))
    rows = spark.createDataFrame([(n, text) for n in (1, 2, 3)], "n long, text string")
    found = claims.sentences(rows).withColumn("id", claims.claim_id(F.col("n"), F.col("line"), F.col("pos")))
    got = [tuple(r) for r in found.select("id", "n", "line", "pos").collect()]
    assert len(got) == 3 * 1320 and len({g[0] for g in got}) == len(got)
    assert [g[1:] for g in sorted(got)] == sorted(g[1:] for g in got)
    with pytest.raises(Exception, match="too many lines"):
        spark.range(1).select(claims.claim_id(F.lit(1), F.lit(1 << 20), F.lit(0))).collect()
