"""Growth of what is shuffled and stored."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from attestry.operators import corroborate, substrings
from attestry.streaming import bands

START = datetime(2024, 1, 1)


def test_a_stream_keeps_each_signature_once(spark, tmp_path):
    """Bands hold names and times; the first 26 of 32 bands find all that agree in 0.8 of 128 places."""
    assert bands.needed(0.8, 32) == 26 and bands.needed(0.5, 32) == 32 and bands.needed(1, 32) == 1
    text = lambda topic, i: " ".join(f"new{w}" if w == 3 * i else f"{topic}{w}" for w in range(120))
    rows = [(f"{topic}{i}", text(topic, i), START + timedelta(hours=i)) for topic in "abc" for i in range(1, 3)]
    schema = "content_hash string, text string, created_at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    bands.link_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/checkpoint", late="60 days")
    assert {tuple(sorted(r)) for r in spark.read.schema("a string, b string").parquet(f"{tmp_path}/store").select("a", "b").collect()} == {(f"{t}1", f"{t}2") for t in "abc"}
    state = spark.read.format("statestore").option("stateVarName", "bands").load(f"{tmp_path}/checkpoint")
    assert state.select("user_map_value.*").columns == ["names", "at"]
    assert state.select(F.explode(F.split("user_map_value.names", "\n"))).count() == 26 * len(rows)
    assert spark.read.parquet(f"{tmp_path}/store/_signatures").filter(F.size("signature") == 128).count() == len(rows)


def test_a_short_needle_moves_no_other_grams(spark):
    """Of 120,000 places of texts only those that may hold a needle's gram leave their task; what is found is exact."""
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefgh \U0001f40d\u00e9") for _ in range(3000)) for _ in range(40)]
    wanted = [texts[3][100:130], texts[5][2995:], texts[9][:8], texts[0] + "x", "\U0001f40d\u00e9", "e", texts[7][200:1900], "nowhere at all"]
    schema = "id long, key string, text string"
    needles, held = (spark.createDataFrame([(i, "k", t) for i, t in enumerate(x)], schema) for x in (wanted, texts))
    found = {tuple(x) for x in substrings.occurrences(needles, held).collect()}
    assert found == {(i, j) for i, n in enumerate(wanted) for j, t in enumerate(texts) if n in t}
    sized = lambda df: df.withColumn("n", F.length("text"))
    asked = substrings._needle_grams(sized(needles.filter("id IN (0, 1, 7)")))
    assert {(x.q, x.one_in) for x in asked.select("q", "one_in").distinct().collect()} == {(8, 1), (4, 1)}
    assert 23 <= substrings.grams(sized(held), asked, True).count() < 500


def test_quantities_move_once_and_crowded_keys_too_come_out_right(spark, monkeypatch):
    """Claims go to their keys in one exchange; summed up by value they come to the same, whatever links their voices."""
    r = random.Random(11)
    spec = "id long, claim string, entity_id string, metric string, value double, unit string, as_of string, source_id string, cluster_id string, independence_group string, tier int, sid string"
    some = lambda *x: r.choice(x)
    rows = [(i, f"claim {i}", some("a", "b", "c", None), some("m", None), some(None, 0.0, -0.0, 1.0, 1.01, 1.3, 7.0, float("nan")), some("u", None), some("2024-01-01", "2024-02", None), f"s{i % 5}", some(None, "x", "y", "z"), some(None, "", "g", "h", "k"), some(1, 2, 3, None), f"S{i + 1}") for i in range(150)]
    rows += [(1000, "alone", "d", "m", None, None, None, "s", None, None, 1, "S9")]
    claims = spark.createDataFrame(rows, spec)
    for relative, absolute in ((None, 0.015), (0.3, None)):
        done = corroborate.corroborate_quantities(claims, corroborate.Policy(), relative, absolute)
        assert done._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        direct = sorted(map(repr, done.collect()))
        with monkeypatch.context() as m:
            m.setattr(corroborate, "HELD", 6)
            assert sorted(map(repr, corroborate.corroborate_quantities(claims, corroborate.Policy(), relative, absolute).select(done.columns).collect())) == direct
            m.setattr(corroborate, "HELD", 0)
            assert sorted(map(repr, corroborate.corroborate_quantities(claims, corroborate.Policy(), relative, absolute).select(done.columns).collect())) == direct
