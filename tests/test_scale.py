"""Steps whose work must follow the input: what they compare, write and send."""

import random

import numpy as np
import pytest

from attestry.operators import alike, near_duplicates
from tests.test_operators import plain_groups


def frequent_sets(n: int, seed: int = 7) -> dict[int, set[int]]:
    """Sets of a few members, most of them frequent, as short sentences have them."""
    r = random.Random(seed)
    members = [r.getrandbits(62) for _ in range(40)]
    return {i: {r.choice(members[: r.choice((6, 15, 40))]) for _ in range(r.choice((1, 2, 3, 5, 9, 14)))} | ({r.getrandbits(62)} if i % 3 else set()) for i in range(n)}


@pytest.mark.parametrize("hot, threshold", [(20_000, 0.5), (30, 0.5), (20_000, 0.8), (20_000, 0.3)])
def test_short_sets_are_grouped_in_full(spark, monkeypatch, hot, threshold):
    monkeypatch.setattr(alike, "HOT", hot)
    monkeypatch.setattr(alike, "OFTEN", 2)
    sets = frequent_sets(300)
    df = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "node long, s array<long>").repartition(3)
    got = {x.node: x.root for x in alike.alike_groups(df, threshold, short=True).collect()}
    assert {k: got.get(k, k) for k in sets} == plain_groups(sets, threshold)
    likeness = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {k: round(v, 9) for k, v in likeness.items() if v >= threshold - 1e-9}
    pairs = near_duplicates.similar_sets(df.withColumnRenamed("node", "id"), threshold, short=True).collect()
    assert {(x.a, x.b): round(x.jaccard, 9) for x in pairs} == want and len(pairs) == len(want)


@pytest.mark.parametrize("short", [True, False])
def test_only_sets_that_may_be_alike_are_linked(spark, short):
    """Sets with a frequent key that are not alike: links would make one large group of them, all of it to be compared."""
    r = random.Random(3)
    rows = [(i, [1, 2, 3, *(r.getrandbits(62) for _ in range(7))]) for i in range(400)]
    df = spark.createDataFrame(rows, "node long, s array<long>")
    assert alike._candidates(df, [], 0.2, None, short)[0].count() == 0
    assert {x.node for x in alike.alike_groups(df, 0.17, short=short).collect()} == set(range(400))


def test_parities_bound_what_differs():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(-(1 << 62), 1 << 62, n)) for n in (0, 1, 5, 300, 4000)] + [np.arange(50), np.arange(3, 60)]
    p = alike.parities(np.concatenate(sets), np.array([len(s) for s in sets]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(p[i] ^ p[j]).sum() <= len(np.setxor1d(a, b))
    assert (p[0] == 0).all() and np.bitwise_count(p[5] ^ p[6]).sum() >= 7
