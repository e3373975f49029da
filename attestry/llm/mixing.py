"""Mixing sources to target weights by weighted fair queueing (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .common import running, running_total, source_key, words

#: Bins of a bracket of virtual times in one look for the cut, and copies that one task puts in order.
TIME_BINS, WINDOW_ROWS = 4096, 200_000


def _sources(rows: DataFrame, weights: tuple, budget: float, cap: float) -> DataFrame:
    """(s, source_size, target) of each source: the budget dealt by weight, nobody above cap times its size.

    In ascending order of cap over weight, a source is full if its share of what the ones before it
    leave would exceed its cap; the rest shares one level. One row per source, so one small window.
    """
    if cap > 2:
        raise ValueError("a document is taken twice at most, so cap is 2 or less")
    per = rows.groupBy("s").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy("s")
    deal = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    whole = Window.partitionBy(F.lit(0))
    per = per.select("s", "source_size", deal.alias("w"), (F.sum("source_size").over(whole) * budget).cast("double").alias("total"), (F.col("source_size") * cap).cast("double").alias("most"))
    by_room = Window.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("w"), "s")
    before = F.coalesce(F.sum("most").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / left)
    full = F.col("most") / F.col("w") <= F.col("level")
    per = per.withColumn("shared", F.max(F.when(~full, F.col("level"))).over(whole))
    return per.select("s", "source_size", F.when(full, F.col("most")).otherwise(F.col("shared") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, seed: str = "mix", size: Column | None = None, buckets: int = 3) -> DataFrame:
    """Give each row of docs (doc_id, text, source) the words that the mix takes of it.

    Sources by code point, null last, weigh ``weights`` in turn and share ``budget`` times all words;
    none gets more than ``cap`` (at most 2) times its size. Each source queues its documents, shuffled
    by a seeded hash, once or twice over; a copy's virtual finish time is the source's words up to its
    end divided by the source's target. All copies are put in order of that time and cut where the
    budget is used up. Whole copies are taken: a document gives 0, 1 or 2 times its size.

    Returns one row per input row: ``row`` (the input row as a struct), size, source_size, target,
    copies, taken. Null text has size 0; rows without words are kept once at no cost. Repeated rows
    are rows of their own. Equal (hash, doc_id, size) are interchangeable. Empty input: no rows.
    ``buckets`` is the number of hexadecimal digits by which each source's queue is split over tasks.
    """
    size = words(F.col("text")) if size is None else size
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(-1)).cast("long").alias("d"), source_key(F.col("source")).alias("s"), size.alias("size"), order.alias("h"))
    light = written(rows.select("d", "s", "size", "h"), "mix")
    sources = written(_sources(light, weights, budget, cap), "sources")
    if sources.count() <= 100_000:
        sources = F.broadcast(sources)
    cut = _cut(_placed(light, sources, buckets), light.agg(F.sum("size")).first()[0] or 0, budget)
    taken = lambda f, e: F.lit(1) if cut is None else (_time(f, e) <= cut).cast("int")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(taken("f1", 1) + taken("f2", 2))
    return _placed(rows, sources, buckets).select("row", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def _time(f: str, epoch: int | Column) -> Column:
    """What copies are ordered by: the virtual finish time, then a total order."""
    return F.struct(F.col(f).alias("f"), "s", "h", "d", (F.lit(epoch) if isinstance(epoch, int) else epoch).alias("epoch"))


def _placed(rows: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Add source_size, target and the virtual finish times f1 and f2 of both copies."""
    rows = running(rows.withColumn("b", F.substring("h", 1, buckets)), ["s"], "b", ["h", "d", "size"], F.col("size"), "upto").join(sources, "s")
    over = lambda x: F.when(F.col("target") > 0, x.cast("double") / F.col("target")).otherwise(F.lit(0.0))
    return rows.withColumns({"f1": over(F.col("upto")), "f2": over(F.col("upto") + F.col("source_size"))})


def _cut(placed: DataFrame, total: int, budget: float) -> Column | None:
    """The last copy in order of virtual time that the budget still holds; None if it holds all."""
    both = placed.filter("size > 0").select("size", F.explode(F.array(_time("f1", 1), _time("f2", 2))).alias("t"))
    both = written(both, "times")
    lo, hi, before, held = 0.0, 4.0, 0, both
    while True:
        # equal bins of the open bracket of times; the one that the budget ends in is looked at again
        place = F.least(F.floor((F.col("t.f") - lo) / (hi - lo) * TIME_BINS), F.lit(TIME_BINS)).cast("int")
        bins = held.withColumn("bin", place).groupBy("bin").agg(F.sum("size").alias("n"), F.min("t.f").alias("lo"), F.max("t.f").alias("hi"), F.count("*").alias("rows"))
        upto = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        hit = bins.withColumn("upto", F.sum("n").over(upto)).filter(F.col("upto") + before > total * budget).orderBy("bin").limit(1).collect()
        if not hit:
            return None
        r = hit[0]
        before += r["upto"] - r["n"]
        lo, hi = r["lo"], r["hi"]
        held = both.filter((F.col("t.f") >= lo) & (F.col("t.f") <= hi))
        if r["rows"] <= WINDOW_ROWS or lo == hi:
            break
    if r["rows"] <= WINDOW_ROWS:
        inside = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        runs = held.withColumn("run", F.sum("size").over(inside))
    else:  # many copies with one time
        runs = running_total(held.select("size", "t.*"), ["f", "s", "h", "d", "epoch"], F.col("size"), "run").withColumn("t", _time("f", F.col("epoch")))
    f, s, h, d, epoch = runs.filter(F.col("run") + before <= total * budget).agg(F.max("t")).first()[0] or (lo, "", "", -2, 0)
    return F.struct(F.lit(float(f)).alias("f"), F.lit(s).alias("s"), F.lit(h).alias("h"), F.lit(d).cast("long").alias("d"), F.lit(epoch).alias("epoch"))


def expand(mixed: DataFrame) -> DataFrame:
    """The rows of the mix: each input row as often as copies says, with its columns."""
    return mixed.filter("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
