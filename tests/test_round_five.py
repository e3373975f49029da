"""Regressions of this round's findings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from attestry.operators import alike


def _flat(sets):
    return np.concatenate(sets), np.array([len(s) for s in sets])


def test_long_sets_are_told_apart_by_their_tallies():
    r = np.random.default_rng(5)
    base = r.integers(-(2**62), 2**62, 14_000)
    sets = []
    for n in (900, 1_500, 4_000, 5_600, 14_000):  # each beside one alike by 0.8 and one that only shares some members
        near = np.concatenate([base[: n - n // 10], r.integers(-(2**62), 2**62, n // 10)])
        far = np.concatenate([base[: n // 10], r.integers(-(2**62), 2**62, n - n // 10)])
        sets += [base[:n], near, far]
    values, lengths = _flat(sets)
    near = alike.tally_test(lengths, pa.array(alike.tallies(values, lengths), pa.binary()))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    only = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert near(i, j, only).all()  # never more than there is
    far = np.arange(5, 15, 3)
    most = lengths[far] * 2 - 2 * 0.8 / 1.8 * lengths[far] * 2
    assert not near(far - 2, far, most).any()
    # their parities, which were all that was looked at, let the longer ones pass
    p = alike.parities(values, lengths)
    assert (np.bitwise_count(p[far - 2] ^ p[far]).sum(1) <= most)[1:].all()


def test_long_texts_with_a_common_passage_are_no_candidates(spark):
    r = np.random.default_rng(6)
    shared = r.integers(-(2**62), 2**62, 40)
    sets = [np.concatenate([shared, r.integers(-(2**62), 2**62, 3_000)]) for _ in range(5)]
    sets.append(np.concatenate([sets[0][:2_900], r.integers(-(2**62), 2**62, 150)]))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(sets)], "node long, s array<long>")
    links = [tuple(x) for x in alike._candidates(rows, [], 0.8, None, False)[0].collect()]
    assert links == [(0, 5)]
    assert sorted(map(tuple, alike.alike_groups(rows, 0.8).collect())) == [(0, 0), (5, 0)]


def test_search_of_all_lists_is_exact_however_many_tasks_there_are(spark):
    from attestry.operators import ivf, retrieve

    r = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(400)], "id long, vector array<double>")
    asked = rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    # many partitions, which stay many
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        file = ivf.build(rows, 16)
        found = ivf.search(ivf.InvertedFile(file.rows, file.centroids, len(file.centroids)), asked, 10)
        pairs = lambda df: {(x.query_id, x.id) for x in df.collect()}
        assert pairs(found) == pairs(retrieve.dense_topk(asked, rows, 10))
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def test_parts_of_a_site_are_its_pages(spark, tmp_path):
    from datetime import datetime

    from attestry.sources import answers

    at, urls = datetime(2024, 1, 1), [f"https://a.b/{i}" for i in range(23)]
    said = {"https://a.b/robots.txt": "User-agent: *\nSitemap: https://a.b/map.xml", "https://a.b/map.xml": "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"} | {u: f"<p>{u}</p>" for u in urls}
    spark.createDataFrame([(u, 200, bytearray(b.encode()), at) for u, b in said.items()], "url string, status int, body binary, fetched_at timestamp").write.parquet(f"{tmp_path}/answers")
    read = lambda **more: answers.asked(answers.register(spark).read.format("site"), ["https://a.b/"], f"{tmp_path}/answers", site={"max_documents": None}, **more).load()
    found = read(parts={"https://a.b/": 4})
    assert found.rdd.getNumPartitions() == 4
    assert sorted(r.url for r in found.collect()) == sorted(urls) == sorted(r.url for r in read().collect())
