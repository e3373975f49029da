"""Shuffles of the searches, and clusters that new documents join."""

import re

from pyspark.sql import functions as F

from attestry import storage
from attestry.operators import block_max, index, retrieve

DOCS = [(i, " ".join(f"word{(i * 7 + k) % 23}" for k in range(i % 9))) for i in range(60)] + [(3, "word1 again"), (3, "word1 again"), (None, "word2"), (70, None), (71, "")]


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_tokens_are_dealt_once(spark):
    """One shuffle, of the texts; rows of one id stay together, whatever their number."""
    docs = spark.createDataFrame(DOCS, "id long, text string")
    post, hashed = index.postings(docs), index.hashed_buckets(docs)
    assert exchanges(post) == 1 and exchanges(hashed) == 1
    got = {(r.id, r.idx): r.weight for r in post.collect()}
    one = index.token_index(F.lit("word1"))
    key = spark.range(1).select(one).first()[0]
    n = {k: v for k, v in got.items() if k[0] == 3}
    # two equal rows count as one text with twice the terms, the third text of this id is another
    weight = lambda tf, size: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / 400))
    assert abs(n[(3, key)] - weight(2, 2)) < 1e-9 and (None, spark.range(1).select(index.token_index(F.lit("word2"))).first()[0]) in got
    assert {r.id for r in hashed.collect()} == {d[0] for d in DOCS if d[0] is not None and d[1]}


def test_postings_stay_where_they_are(spark, monkeypatch):
    """Few terms go to the postings; many are dealt with them, with the same result."""
    docs = spark.createDataFrame([d for d in DOCS if d[0] is not None], "id long, text string")
    post = storage.written(index.postings(docs), "postings")
    asked = post.filter("id % 20 = 1").select(F.col("id").alias("query_id"), "idx", "weight")
    want = sorted(map(tuple, retrieve.sparse_topk(asked, post, 60, 5).collect()))
    blocks = lambda: sorted(map(tuple, block_max.search(asked, block_max.build(post, 60), 5).rows.select("query_id", "id", "score", "rank").collect()))
    same = [(q, i, s, r) for q, i, s, r in want]
    assert len(want) > 5 and blocks() == same
    plan = retrieve.sparse_topk(asked, post, 60, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
    for module in (storage, block_max):
        monkeypatch.setattr(module, "SENT", 0)
    assert sorted(map(tuple, retrieve.sparse_topk(asked, post, 60, 5).collect())) == want and blocks() == same


def test_a_new_text_merges_stored_clusters(spark):
    """Two stored texts that are not alike, and a new one that is alike with both."""
    from datetime import datetime, timedelta

    from attestry.operators import signatures

    start = datetime(2024, 1, 1)
    rows = [(name, [0] * 128 if name == "b" else [k] * 20 + [0] * 108, start + timedelta(seconds=i)) for i, (name, k) in enumerate([("a", 1), ("c", 2), ("b", 0)])]
    rows[0] = ("a", [1] * 20 + [0] * 108, start)
    rows[1] = ("c", [0] * 108 + [2] * 20, start + timedelta(seconds=1))
    schema = "content_hash string, signature array<long>, created_at timestamp"
    empty = spark.createDataFrame([], schema + ", cluster_id string")
    held = storage.written(signatures.assign(spark.createDataFrame(rows[:2], schema), empty, start), "held")
    new = spark.createDataFrame(rows[2:], schema)
    named = lambda df: {r.content_hash: r.cluster_id for r in df.collect()}
    assert named(held) == {"a": "a", "c": "c"} and named(signatures.assign(new, held)) == {"b": "a"}
    assert named(signatures.merged(new, held)) == {"a": "a", "b": "a", "c": "a"}
