"""Texts and tables that earlier rounds' operators failed on."""

from pyspark.sql import functions as F

from attestry.llm import merkle


def test_fingerprint_of_many_lines(spark):
    """Lines without a blank one between them are one section, however many they are."""
    lines = "".join(f"line {i}\n" for i in range(50_000))
    rows = spark.createDataFrame([(lines,), (lines + "\nnext\n",)], "t string")
    one, two = (r.f.split(":")[1] for r in rows.select(merkle.fingerprint(F.col("t")).alias("f")).collect())
    assert one.count(".") == 49_999 and "/" not in one
    assert two.count("/") == 1 and two.split("/")[0].count(".") == 49_999


def test_training_brings_no_texts_to_the_driver(spark, monkeypatch):
    """The dictionaries are made in a task, and are those that the plain fit makes of the same texts in the same order."""
    import hashlib
    import random

    import numpy as np

    from attestry.llm import toxicity

    r = random.Random(3)
    words = ["loser", "trash", "pathetic", "worthless"], ["harbour", "ferry", "valley", "bridge", "mill"]
    docs = [(i, " ".join(r.choice(words[0] if i % 3 == 0 and r.random() < 0.5 else words[1]) for _ in range(30))) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    parts = {x.doc_id: x.p for x in rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.FOLDS)).cast("int").alias("p")).collect()}
    want = toxicity.fit([(t, int(i % 3 == 0), parts[i]) for i, t in sorted(docs, key=lambda d: (hashlib.md5(str(d[0]).encode()).hexdigest(), d[0]))])
    monkeypatch.setattr(toxicity, "_held", None)  # of the driver; tasks import their own
    got = toxicity.train(rows, labels)
    assert got.dictionaries == want.dictionaries and np.allclose(got.weights, want.weights) and len(got.weights) > 10
    none = toxicity.train(rows, labels.limit(0))
    assert np.allclose(1 / (1 + np.exp(-none.weights)), 1 / 3)
