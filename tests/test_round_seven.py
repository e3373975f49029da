"""Results that are whole, and what a task holds."""

import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from attestry.operators import corroborate, ivf, near_duplicates, signatures, verify
from attestry.plans import workflows
from attestry.sources.config import Profile
from attestry.streaming import bands


def test_event_pairs_lose_no_claim(spark):
    """Claims of one text have a first one; with the others beside it, all links between claims follow."""
    said = ["The port of Arden closed on Monday", "the port of Arden closed Monday morning", "Nothing else happened anywhere today"]
    rows = [(1, said[0]), (2, said[1]), (3, said[0]), (4, said[2]), (5, said[1]), (6, said[0]), (7, "of the"), (8, "of the"), (9, None), (10, None)]
    found = [tuple(r) for r in corroborate.event_pairs(spark.createDataFrame(rows, "id long, claim string")).collect()]
    assert sorted((a, b, copy) for a, b, _, copy in found) == [(1, 2, False), (1, 3, True), (1, 6, True), (2, 5, True)]
    assert all(j == 1 if copy else 0.5 <= j < 1 for *_, j, copy in found)
    first = {b: a for a, b, _, copy in found if copy}
    linked = {(a, b) for a, b, _, copy in found if not copy}
    every = {(x, y) for x, _ in rows for y, _ in rows if x < y for a, b in [sorted((first.get(x, x), first.get(y, y)))] if (a, b) in linked or a == b}
    tokens = {i: set(t.lower().split()) - {"the", "of", "on"} for i, t in rows if t}
    assert every == {(x, y) for x in tokens for y in tokens if x < y and 2 * len(tokens[x] & tokens[y]) >= len(tokens[x] | tokens[y]) > 0}


class Counted:
    """A map state that counts how often it is asked."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        if name not in ("exists", "getValue", "updateValue", "removeKey", "iterator"):
            raise AttributeError(name)
        done = {"exists": lambda: bool(self.held), "getValue": self.held.get, "updateValue": self.held.__setitem__, "removeKey": self.held.pop, "iterator": lambda: iter(self.held.items())}[name]
        self.calls += 1
        return done


@pytest.mark.parametrize("days", [1, 10])
def test_a_shelf_asks_its_state_once_for_each_box(days):
    """However many bands a batch has; who meets whom is what comparing all says, whatever batches they come in."""
    r, state = random.Random(3), Counted()
    shelf = bands.Bands(days)
    shelf.init(SimpleNamespace(getMapState=lambda *_: state, registerTimer=lambda _: None))
    rows = [(r.randrange(-700, 700) * bands.SHELVES + 5, r.randrange(30) * bands.DAY_MS, f"n{r.randrange(900)}") for _ in range(3000)]
    seen, many = {}, {}
    for part in (rows[:1200], rows[1200:1210], rows[1210:]):
        state.calls = 0
        df = pd.DataFrame(part, columns=["k", "at", "content_hash"]).assign(signature=None)
        found = pd.concat([pd.DataFrame(), *shelf.handleInputRows((5,), iter([df.iloc[:7], df.iloc[7:]]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))])
        boxes = {k // bands.SHELVES % bands.BOXES for k, *_ in part}
        assert state.calls <= 2 * len(boxes) + 1
        fresh = {}
        for k, at, name in sorted(part):
            if name not in seen.setdefault(k, {}):
                seen[k][name] = fresh[k, name] = at
        want = set()
        for k, members in seen.items():
            met = [(n, at, (k, n) in fresh) for n, at in members.items() if any(m != n and abs(a - at) <= days * bands.DAY_MS and ((k, n) in fresh or (k, m) in fresh) for m, a in members.items())]
            if met:
                want.add(frozenset(met))
        got = {frozenset((x.node, x.at, x.fresh) for x in g.itertuples()) for _, g in found[found["k"].notna()].groupby("k")}
        assert got == want and found["signature"].isna().all()
        many[len(part)] = len(want)
    assert min(many[1200], many[1790]) > 30


@pytest.mark.parametrize("n", [1, 511, 512, 1025])
def test_signatures_of_blocks(n):
    members = np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n)
    want = [min((a * (int(m) & 0xFFFFFFFF) + b) % near_duplicates.PRIME for m in members) for a, b in near_duplicates.coefficients()]
    assert near_duplicates.least_hashes(members).tolist() == want


def test_signatures_go_to_bands_that_several_have(spark, monkeypatch):
    """Once for each set of members, not for each of 32 bands; links are those of comparing all."""
    r, start = random.Random(5), datetime(2024, 1, 1)
    base = [[r.randrange(1 << 32) for _ in range(128)] for _ in range(200)]
    rows = [(f"n{i:03}", s, start + timedelta(days=i % 40)) for i, s in enumerate(base)]
    rows += [(f"m{i:03}-{j}", [x + 1 if j * 7 <= p < j * 7 + 20 else x for p, x in enumerate(base[i])], start + timedelta(days=(i + 3 * j) % 40)) for i in range(20) for j in range(3)]
    df = spark.createDataFrame([*rows, ("none", None, start)], "content_hash string, signature array<long>, created_at timestamp")
    moved, run_links = [], signatures.run_links
    monkeypatch.setattr(signatures, "run_links", lambda keyed, *rest: moved.append(keyed.count()) or run_links(keyed, *rest))
    for days in (5, None):
        found = {tuple(x) for x in signatures.components(signatures.band_links(df, days)).collect()}
        alike = lambda x, y: sum(p == q for p, q in zip(x[1], y[1], strict=True)) >= 0.8 * 128 and (days is None or abs(x[2] - y[2]) <= timedelta(days=days))
        pairs = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and alike(x, y)]
        assert pairs and found == {tuple(x) for x in signatures.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert 80 <= moved[0] == moved[1] < 800 < 26 * len(rows)


def test_queries_beside_their_lists_come_in_pieces():
    """3,000 queries of 100 lists each are 300,000 vectors: a task holds some thousands of them."""
    r = np.random.default_rng(2)
    m, centroids = (ivf.unit(r.normal(size=(n, 8))) for n in (3000, 128))
    pieces = list(ivf.probed(pa.array(np.arange(3000) * 7), m, centroids, 100))
    assert max(x.num_rows for x in pieces) <= ivf.ASKED and sum(x.num_rows for x in pieces) == 300_000
    whole = pa.Table.from_batches(pieces)
    own = whole.column("query_id").to_numpy()
    assert (own == np.repeat(np.arange(3000) * 7, 100)).all()
    assert (np.array(whole.column("vector").to_pylist()) == m[own // 7]).all()
    near = np.sort(whole.column("list").to_numpy().reshape(3000, 100), axis=1)
    assert (near == np.sort(np.argsort(-(m @ centroids.T), axis=1)[:, :100], axis=1)).all()
    assert next(ivf.probed(pa.array([1]), m[:1], np.repeat(centroids, 80, 0), 10_000)).num_rows == 10_000


def test_a_body_is_made_for_those_who_ask(spark):
    """Verdicts of any number of claims need no body, which is one row; a replay compares verdicts. Asked for, it is made once."""
    texts = ["The harbour office cancelled all evening ferries to the islands.", "All evening ferries to the islands were cancelled by the harbour office.", "Two paper mills plan to share one water treatment plant."]
    rows = [(f"S{i}", f"s{i}", f"c{i}", t, None, [], None) for i, t in enumerate(texts, 1)]
    evidence = spark.createDataFrame(rows, "sid string, source_id string, cluster_id string, text string, published_at timestamp, entity_ids array<string>, title string")
    sources = spark.createDataFrame([(f"s{i}", {"general": 1}, f"g{i}") for i in (1, 2, 3)], "source_id string, tags map<string,int>, independence_group string")
    made = []
    seams = workflows.Seams(synthesize=lambda claims, seen: made.append(1) or verify.brief_bodies(claims, seen))
    profile = Profile("d", ["general"])
    first = workflows.tail(evidence, sources, profile, seams)
    again = workflows.replay(evidence, sources, profile, first["verdicts"], seams)
    assert sorted(r.verdict for r in first["verdicts"].collect()) == ["attributed", "confirmed"] and again["difference"].count() == 0 and not made
    named = {"evidence": evidence} | first
    assert set(named) == {"evidence", "claims", "verdicts", "body", "checks", "shipped", "precision"} and not made
    assert named["precision"].first().precision == 1.0 and "evening ferries" in named["shipped"].first().shipped and len(made) == 1
    assert named["body"].count() == 1 and named["checks"].count() == 2 and len(made) == 1
