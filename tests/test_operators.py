import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.operators import alike, corroborate, entities, governance, index, near_duplicates, observe, registry, retrieve, signatures, snapshots, vector_index, verify
from attestry.operators.entities import Dictionary
from attestry.operators.graph import components

REG = [
    ("a", "A", "rss", "en", "cc", {"news": 1}, "g1", "active"), ("b", "B", "rss", "en", "cc", {"news": 2, "oil": 1}, "", "active"),
    ("c", "C", "rss", "en", "cc", {"oil": 2}, None, "paused"), ("d", "D", "odd", "en", "cc", {"news": 3}, "g1", "active"), ("e", "E", "rss", "en", "cc", None, "g1", None),
]


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([(*r, []) for r in REG], registry.SCHEMA)


def evaluated(spark, column, **values):
    """The value of a column expression over one row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_scope_and_tiers(sources):
    assert {r.source_id: r.tier for r in registry.in_scope(sources, ["news", "oil"], 2).collect()} == {"a": 1, "b": 1}
    rows = registry.with_source(sources.select("source_id"), sources, ["news"]).collect()
    assert {r.source_id: (r.tier, r.independence_group) for r in rows} == {"a": (1, "g1"), "b": (2, "b"), "c": (None, "c"), "d": (3, "g1"), "e": (None, "g1")}


def test_problems(spark, sources):
    profiles = spark.createDataFrame([("x", ["news"], 3, "15 06 * * *"), ("y", ["gas"], 3, "99 99 * * *"), ("z", ["oil"], 1, None)], "domain string, include_tags array<string>, min_tier int, cron string")
    got = sorted((r.problem, r.subject) for r in registry.problems(sources, profiles, ["rss"]).collect())
    assert got == [("bad schedule", "y: 99 99 * * *"), ("no source in scope", "y"), ("tag without a source", "gas"), ("unknown adapter", "d: odd")]


def test_tokens_and_sentences(spark):
    assert evaluated(spark, tx.tokenize(F.col("t")), t="The AB-1234 'Ever-Given.' is at $84.5/bbl, a.b_ x") == ["ab-1234", "ever-given", "84.5/bbl", "a.b"]
    assert evaluated(spark, tx.tokenize(F.col("t")), t=None) == []
    assert evaluated(spark, tx.split_sentences(F.col("t")), t="[S9] One. [S1] [S2] Two! Three? [S3]") == ["[S9] One. [S1] [S2]", "Two!", "Three? [S3]"]
    assert evaluated(spark, tx.split_sentences(F.col("t")), t="  ") == []
    assert evaluated(spark, tx.sids(F.col("t")), t="a [S10] b [S2] [S10]") == ["S2", "S10"]
    assert evaluated(spark, tx.strip_verdict_labels(F.col("t")), t="X (confirmed by 2 independent sources). [S1]") == "X . [S1]"
    assert evaluated(spark, tx.json_path(F.col("t"), "a.1.b", F.lit("none")), t='{"a": [1, {"b": "c"}]}') == "c"
    assert evaluated(spark, tx.netloc(F.col("t")), t="https://u@WWW.Site.org:80/x") == "site.org"
    assert evaluated(spark, tx.page_published(F.col("t")), t='<time datetime="bad"></time>"datePublished": "2024-03-01T10:00:00Z"') == datetime(2024, 3, 1, 10)


def test_entities(spark):
    d = Dictionary([("Strait of Hormuz", "hormuz", "place"), ("Hormuz", "hormuz", "place"), ("Brent", "brent", "oil"), ("brent", "other", "oil"), ("war-risk premium", "premium", "metric")])
    assert evaluated(spark, d.tag(F.col("t")), t="BRENT rose; the Strait of Hormuz (Hormuz!) and a war-risk premium. Brents, éBrent") == ["brent", "hormuz", "premium"]
    assert evaluated(spark, d.expand(F.col("t")), t="hormuz news") == "hormuz news Hormuz Strait of Hormuz hormuz"
    assert evaluated(spark, Dictionary([]).tag(F.col("t")), t="x") == []


def test_first_writer_wins(spark):
    rows = [("h1", "b", 5, 2), ("h1", "a", 5, 1), ("h2", "a", 1, 3), ("h3", "c", 1, 4)]
    items = spark.createDataFrame(rows, "content_hash string, source_id string, fetched_at int, ord long")
    got = snapshots.first_writers(items, spark.createDataFrame([("h3",)], "content_hash string")).collect()
    assert sorted((r.content_hash, r.source_id) for r in got) == [("h1", "a"), ("h2", "a")]


def test_components(spark):
    import random

    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


def test_similar_sets_finds_all(spark):
    import random

    r = random.Random(2)
    base = [r.sample(range(60), 20) for _ in range(12)]
    sets = {i: sorted({*r.choice(base)[: r.randrange(14, 21)], *r.sample(range(100, 400), r.randrange(4))}) for i in range(80)}
    want = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.8}
    df = spark.createDataFrame(list(sets.items()), "id long, s array<long>")
    assert want and {(x.a, x.b) for x in near_duplicates.similar_sets(df, 0.8).collect()} == want


def test_voices_do_not_grow_with_copies_or_group_mates(spark):
    spec = "id long, claim_group int, cluster_id string, independence_group string, tier int"
    rows = [(1, 1, "c1", "g1", 1), (2, 1, "c2", "g2", 2), (3, 1, None, "g3", 2), (4, 1, None, None, 1), (5, 1, None, "", 3)]
    count = lambda x: corroborate.voices(spark.createDataFrame(x, spec)).first()[1:]
    assert count(rows) == (5, 2)
    assert count(rows + [(6, 1, "c1", "g9", 3), (7, 1, "c8", "g2", 3)]) == (5, 2)
    # a chain: g1 - c1 - g2
    assert count(rows + [(8, 1, "c1", "g2", 3)]) == (4, 2)


def test_large_dictionaries_are_looked_up(spark, monkeypatch):
    """Lookups find what the pattern finds."""
    r = random.Random(9)
    words = ["oil", "Oil price", "price", "war-risk", "war", "risk premium", "x", "É", "été 2", "(a)", "a b c"]
    d = Dictionary([(w, f"id{i % 7}", "t") for i, w in enumerate(words)])
    texts = [None, "", *(" ".join(r.choice([*words, "oil-price", "prices", "OIL", "warrisk", "and", "b_c", "(a)x"]) for _ in range(12)) for _ in range(80))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    read = lambda: sorted(map(str, rows.select("i", d.tag(F.col("t")).alias("ids"), d.expand(F.col("t")).alias("more")).collect()))
    want = read()
    monkeypatch.setattr(entities, "MOST", 0)
    assert read() == want


def test_value_groups_are_anchored(spark):
    """Ascending values join the first anchor that they agree with, as a plain fold over all anchors says."""
    import random

    r = random.Random(5)
    values = {"a": [80.0, 80.3, 80.5], "b": [], **{f"k{i}": sorted({r.choice((0.0, -1.0, 1.0)) * r.randrange(400) / 4 for _ in range(40)}) for i in range(4)}}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")

    def plain(vs, relative, absolute):
        anchors = []
        for v in vs:
            if not any(a == v or (absolute is not None and abs(a - v) <= absolute) or (relative is not None and abs(a - v) <= relative * max(abs(a), abs(v))) for a in anchors):
                anchors.append(v)
        return anchors

    for relative, absolute in ((0.005, None), (None, None), (None, 1.0), (0.2, 0.5), (1.5, None)):
        got = {}
        for x in corroborate.value_groups(rows, ["k"], relative, absolute).collect():
            got.setdefault(x.k, set()).add(x.anchor)
        assert {k: sorted(got.get(k, ())) for k in values} == {k: plain(vs, relative, absolute) for k, vs in values.items()}
    assert plain(values["a"], 0.005, None) == [80.0, 80.5] and plain(values["a"], None, None) == [80.0, 80.3, 80.5] and plain(values["a"], None, 1.0) == [80.0]


def test_fallbacks(spark):
    spec = "id long, claim string, modality string, sid string, source_id string, cluster_id string, independence_group string, tier int"
    c = spark.createDataFrame([(1, "The northern dam was closed for urgent repairs.", "asserted", "S1", "a", "x", "a", 2)], spec)
    got = {f: corroborate.corroborate_events(c, corroborate.Policy(2, 1, f)).first() for f in ("attribute", "flag", "drop")}
    assert [(r.verdict, r.dropped) for r in got.values()] == [("attributed", False), ("insufficient", False), ("insufficient", True)]
    # tiers change verdicts, never order or text
    assert {r.text for r in got.values()} == {"The northern dam was closed for urgent repairs."}


def test_order_of_claims_is_all_that_rows_order_changes(spark):
    spec = "id long, claim string, modality string, sid string, source_id string, cluster_id string, independence_group string, tier int"
    rows = [(i, f"Port authorities suspended tanker transits number{i % 3} through the strait", "asserted", f"S{i}", f"s{i % 4}", f"c{i % 5}", f"g{i % 4}", i % 3 + 1) for i in range(12)]
    a, b = (sorted(map(str, corroborate.corroborate_events(spark.createDataFrame(x, spec).repartition(3)).collect())) for x in (rows, rows[::-1]))
    assert a == b


def test_health(spark):
    at = lambda h: datetime(2024, 1, 31, h)
    rows = [("a", 1, at(1), "ok", 5, 1, None), ("a", 2, at(2), "error", 0, 0, "x"), ("a", 3, at(3), "error", 0, 0, ""), ("b", 4, at(1), "error", 0, 0, "e"), ("b", 5, at(2), "not_modified", 0, 0, None)] + [("c", 10 + i, at(i), "error", 1, 0, f"e{i}") for i in range(4)]
    e = spark.createDataFrame(rows, "source_id string, event_id long, started_at timestamp, status string, items_seen long, snapshots_new long, error string")
    got = {r.source_id: (r.status, r.consecutive_failures, r.last_error, r.items_in_window) for r in observe.source_health(e, spark.createDataFrame([(x,) for x in "abcd"], "source_id string"), at(4), 2).collect()}
    assert got == {"a": ("degraded", 2, "x", 0), "b": ("ok", 0, "e", 0), "c": ("failing", 4, "e3", 2), "d": ("unknown", 0, None, 0)}


def test_golden_report(spark):
    claims = spark.createDataFrame([("k", "Tankers STOPPED", "event", "confirmed"), ("k", "tankers stopped again", "event", "attributed"), ("k", "rate 5", "quantitative", "confirmed")], "case string, text string, claim_type string, verdict string")
    wants = spark.createDataFrame([("k", "tankers stopped", None, "confirmed"), ("k", "rate", "quantitative", "confirmed"), ("k", "nothing", None, "confirmed"), ("j", "rate", None, "confirmed")], "case string, needle string, claim_type string, verdict string")
    got = {(r.case, r.needle): (r.passed, r.got) for r in observe.golden_outcomes(wants, claims).collect()}
    assert got == {("k", "tankers stopped"): (False, ["attributed", "confirmed"]), ("k", "rate"): (True, ["confirmed"]), ("k", "nothing"): (False, []), ("j", "rate"): (False, [])}
    r = observe.golden_report(observe.golden_outcomes(wants, claims), spark.createDataFrame([("k", 0.9), ("j", 1.0)], "case string, precision double")).first()
    assert (r.expectation_pass_rate, r.citation_precision, r.ok) == (0.25, 0.9, False)
    assert observe.golden_report(observe.golden_outcomes(wants.limit(0), claims), spark.createDataFrame([], "precision double")).first().ok


def test_retrieval(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)] + [(40, [0.0, 0.0, 0.0])], "id long, vector array<double>")
    q = v.filter("id < 3").withColumnRenamed("id", "query_id")
    got = retrieve.dense_topk(q, v, 4).collect()
    assert all(r.score == 1.0 for r in got if r["rank"] == 1) and len(got) == 12
    legs = [spark.createDataFrame(x, "query_id long, id long, rank int") for x in ([(1, 5, 1), (1, 6, 2)], [(1, 6, 1)])]
    assert [(r.id, r["rank"]) for r in retrieve.fuse(legs, 5).orderBy("rank").collect()] == [(6, 1), (5, 2)]
    hits = spark.createDataFrame([(2, 9, 0.5), (1, 9, 0.5), (1, 8, 0.9)], "query_id long, id long, score double")
    assert [(r.sid, r.id, r.query_id) for r in retrieve.assemble(hits, 5).orderBy("sid").collect()] == [("S1", 8, 1), ("S2", 9, 1)]


def test_splitting(spark):
    assert index.split_text("") == [""] and index.split_text("a b", 10, 2) == ["a b"]
    parts = index.split_text("word " * 1000, 100, 20)
    assert all(len(p) <= 100 for p in parts) and parts[0].endswith(" ")
    assert all(len(p) <= 10 for p in index.split_text("x" * 95, 10, 3))


def test_candidates(spark):
    links = spark.createDataFrame([(2, "https://new.org/b", "B"), (1, "https://www.new.org/a", "A"), (3, "https://old.org", "O"), (4, "https://seen.org", "S"), (5, "nothing", "N")], "ord long, url string, title string")
    got = governance.propose(links, spark.createDataFrame([("http://old.org/x",)], "url string"), spark.createDataFrame([("seen.org",)], "netloc string"))
    assert [tuple(r) for r in got.collect()] == [("new.org", "https://www.new.org/a", "A", 2, "new_org", "pending")]
    log = spark.createDataFrame([("new.org", 1, "approved", None), ("new.org", 2, "rejected", "spam")], "netloc string, decided_at int, status string, reason string")
    assert governance.listed(governance.decided(got, log), "rejected").first().reason == "spam"
    assert "license: UNREVIEWED" in governance.stanza(got).first().yaml


def test_unsupported_sentences_never_ship(spark):
    body = "# Head\nTankers stopped on Monday. [S1] Made up things here. [S1]\nNo citation at all.\n---\nTankers stopped on Monday. [S7]"
    bodies = spark.createDataFrame([(1, body)], "body_id long, body string")
    evidence = spark.createDataFrame([(1, "S1", "On Monday the tankers stopped.")], "body_id long, sid string, text string")
    clean = verify.validate_citations(bodies, evidence).first()
    assert (clean.invalid, clean.cited, clean.uncited) == (1, ["S1"], 3)
    again = spark.createDataFrame([(1, clean.cleaned)], "body_id long, body string")
    checks = verify.check_bodies(again, evidence)
    out = verify.drop_unsupported(again, checks).first()
    assert out.shipped == "# Head\nTankers stopped on Monday. [S1]\n---" and out.n_dropped == 3
    assert verify.precision(checks).first().precision == 0.25


def plain_groups(sets, threshold):
    """Components of all pairs."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


@pytest.mark.parametrize("hot, part, often", [(20_000, 500_000, 8), (3, 200, 2)])
def test_alike_groups(spark, monkeypatch, hot, part, often):
    """Families around a few bases, hot members, halves that are not alike, tiny and empty sets; keys and groups split or not."""
    monkeypatch.setattr(alike, "HOT", hot)
    monkeypatch.setattr(alike, "OFTEN", often)
    r = random.Random(4)
    common = [r.getrandbits(62) for _ in range(20)]
    bases = [{r.getrandbits(62) for _ in range(r.choice((5, 20, 60)))} for _ in range(8)]
    sets = {}
    for i in range(160):
        base = r.choice(bases)
        s = set(r.sample(sorted(base), len(base) - r.randrange(0, 1 + len(base) // 6))) | {r.getrandbits(62) for _ in range(r.randrange(3))}
        sets[i] = s | set(common) if i % 4 == 0 else s
    sets |= {900: set(), 901: {1, 2, 3, 4}, 902: {1, 2, 3, 4, 5}, 903: {7}, 904: set(common) | {8}, 905: set(common) | {9}}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()] + [(901, [1, 2, 3, 4])], "node long, s array<long>").repartition(3)
    got = {x.node: x.root for x in alike.alike_groups(df, 0.8, part=part).collect()}
    want = plain_groups(sets, 0.8)
    assert {k: got.get(k, k) for k in sets} == want and len(set(want.values())) < len(want) - 50


def test_clusters_name_the_smallest(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = [(5, text), (3, text + " eighteen"), (9, text), (4, ""), (8, None), (7, "something else that is quite unlike the others here")]
    got = {r.id: r.root for r in near_duplicates.clusters(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 4: 4, 8: 8, 7: 7}


def test_signature_store(spark):
    at = datetime(2024, 3, 1)
    words = [f"word{i}" for i in range(60)]
    text = lambda k: " ".join([*words[:-k], *[f"new{i}" for i in range(k)]])
    made = lambda rows: signatures.signatures(spark.createDataFrame(rows, "content_hash string, text string, created_at timestamp"))
    first = made([("a" * 64, text(1), at), ("b" * 64, "", at), ("f" * 64, text(1), at - timedelta(days=20))])
    empty = spark.createDataFrame([], "content_hash string, signature array<long>, created_at timestamp, cluster_id string")
    held = signatures.assign(first, empty, at)
    old = {r.content_hash[0]: r.cluster_id for r in held.collect()}
    assert old["b"] == "b" * 16 and old["a"] == old["f"] == "f" * 16
    new = made([("c" * 64, text(2), at), ("d" * 64, "quite another text " * 9, at), ("a" * 64, text(1), at)])
    got = {r.content_hash[0]: r.cluster_id for r in signatures.assign(new, held, at).collect()}
    assert got == {"c": "f" * 16, "d": "d" * 16}
    # what is older than the window takes no part
    late = signatures.assign(new, held.filter("content_hash LIKE 'f%'"), at)
    assert {r.content_hash[0]: r.cluster_id for r in late.collect()} == {"a": "a" * 16, "c": "a" * 16, "d": "d" * 16}


def test_blobs_are_written_once(spark, tmp_path):
    rows = [("ab1", b"x"), ("ab1", b"x"), ("cd2", b"y")]
    items = spark.createDataFrame(rows, "content_hash string, content binary")
    folder = f"file://{tmp_path}/blobs"
    assert (snapshots.write_blobs(items, folder), snapshots.write_blobs(items, folder)) == (2, 0)
    got = spark.read.parquet(folder).select("blob_uri", "content").collect()
    assert sorted((r.blob_uri, bytes(r.content)) for r in got) == [("ab/ab1", b"x"), ("cd/cd2", b"y")]


def test_vector_index(spark, tmp_path):
    one = vector_index.VectorIndex(spark, f"file://{tmp_path}/index")
    points = lambda *rows: spark.createDataFrame(rows, "id string, vector array<double>, title string")
    with pytest.raises(vector_index.IndexMismatch):
        one.upsert(points(("a", [1.0, 2.0], "x")))
    one.ensure(2, "e1")
    assert one.read() is None
    one.upsert(points(("a", [1.0, 2.0], "x"), ("b", [0.0, 1.0], "y")))
    one.upsert(points(("a", [3.0, 4.0], "z"), ("a", [3.0, 4.0], "z")))
    assert sorted((r.id, r.vector, r.title) for r in one.read().collect()) == [("a", [3.0, 4.0], "z"), ("b", [0.0, 1.0], "y")]
    for wrong in ((3, "e1"), (2, "e2")):
        with pytest.raises(vector_index.IndexMismatch):
            one.ensure(*wrong)
    with pytest.raises(Exception, match="another dimension"):
        one.upsert(points(("c", [1.0], "x")))
    assert one.read().count() == 2
    chunks = spark.createDataFrame([("h:0", "t")], "chunk_id string, title string")
    import uuid

    got = vector_index.points(chunks, spark.createDataFrame([("h:0", [1.0])], "chunk_id string, vector array<double>")).first()
    assert got.id == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:h:0"))


def test_decisions(spark):
    c = spark.createDataFrame([("x.org", "u")], "netloc string, url string")
    log = governance.decision(c, "x.org", "rejected", datetime(2024, 1, 1), "spam")
    assert [tuple(r) for r in governance.decided(c, log).select("netloc", "status", "reason").collect()] == [("x.org", "rejected", "spam")]
    with pytest.raises(KeyError):
        governance.decision(c, "y.org", "approved", datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        governance.decision(c, "x.org", "rejected", datetime(2024, 1, 1))


def test_golden_needles(spark):
    """Needles inside tokens, across tokens, of one token, and with other expectations in the case."""
    claims = spark.createDataFrame([("k", "The old bridge is closed", "event", "confirmed"), ("k", "The old bridge is closed", "event", "confirmed"), ("k", "Rates rose to 5", "quantitative", "attributed")], "case string, text string, claim_type string, verdict string")
    needles = {"old BRIDGE is": True, "bridg": True, "d bridge i": True, "bridge": True, " is ": True, "the old bridge is closed": True, "rates": False, "old  bridge": False, "": False}
    wants = spark.createDataFrame([("k", n, None, "confirmed") for n in needles], "case string, needle string, claim_type string, verdict string")
    assert {r.needle: r.passed for r in observe.golden_outcomes(wants, claims).collect()} == needles


def test_fixed_values():
    """Constants that both sides of an oracle share, held against what they must be."""
    assert len(tx.STOPWORDS) == 42 and tx.TOKEN == r"[a-z0-9][a-z0-9\-\._/]*" and tx.NEGATIONS == ("denied", "deny", "denies", "no", "not", "never")
    assert near_duplicates.PRIME == 2**32 + 15 and near_duplicates.coefficients()[0] == (1406932607, 654583775)
