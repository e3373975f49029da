"""K-d tree partitioning of documents into shards of near equal bytes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .common import running, running_total

#: The metadata dimensions, in order of preference when several are equally wide.
DIMENSIONS = ("doc_id", "bytes", "source", "lang")
#: Equal bins of a bracket in one look at it. Each look narrows a bracket by this factor, so any median of 64-bit
#: values is settled after six looks at the values and four at their ties.
BINS = 4096
#: Distinct values of a column, nodes and shards that are sent to every task, at most.
BROADCAST_ROWS = 200_000


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _ranks(rows: DataFrame, c: str) -> DataFrame:
    """(_value, _rank) of a column's distinct values in order by code point, from 1."""
    values = running_total(rows.filter(F.col(c).isNotNull()).select(F.col(c).alias("_value")).distinct(), ["_value"], F.lit(1), "_rank")
    return written(values.select("_value", F.col("_rank").cast("long").alias("_rank")), "ranks")


def _ranked(rows: DataFrame, c: str, ranks: DataFrame, many: int, out: str) -> DataFrame:
    return rows.join(_sent(ranks, many), F.col(c) == F.col("_value"), "left").withColumn(out, F.coalesce("_rank", F.lit(0))).drop("_value", "_rank", c)


def _measured(docs: DataFrame) -> DataFrame:
    """row, size, text_crc32, the dimensions x0.. as longs, and tie, a uniform 40-bit number of the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc, size = F.crc32(text.cast("binary")), F.octet_length(text).cast("long") + 1
    return docs.select(F.struct("*").alias("row"), size.alias("size"), crc.alias("text_crc32"), F.pmod(F.xxhash64("doc_id", crc), F.lit(1 << 40)).alias("tie"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("x0"), F.floor(F.log2(size.cast("double")) * 1024).cast("long").alias("x1"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"))


def _x(dim: str = "dim") -> Column:
    return F.element_at(F.array(*[F.col(f"x{i}") for i in range(len(DIMENSIONS))]), F.col(dim) + 1)


def _joined(rows: DataFrame, nodes: list[tuple], schema: str) -> DataFrame:
    """Rows of the nodes that are listed, with what is known of them."""
    return rows.join(_sent(rows.sparkSession.createDataFrame(nodes, schema), len(nodes)), "node")


def _heavy_bins(rows: DataFrame, state: list[tuple]) -> dict:
    """For each bracket (node, dimension, value or None, lo, hi, weight wanted) the first bin in which the sum of
    weights reaches the wanted one: its bounds by value, its weight and the weight before it."""
    seen = _joined(rows, state, "node long, dim int, at long, lo long, hi long, goal double").withColumn("v", F.when(F.col("at").isNull(), _x()).otherwise(F.col("tie")))
    seen = seen.filter("v BETWEEN lo AND hi").filter(F.col("at").isNull() | (_x() == F.col("at")))
    # a bracket of longs may be wider than a long
    far, double = F.col("hi").cast("double") - F.col("lo").cast("double"), lambda c: F.col(c).cast("double")
    into = F.when(far > 4e18, double("v") - double("lo")).otherwise((F.col("v") - F.col("lo")).cast("double"))
    place = F.least(F.floor(into / (far + 1) * BINS), F.lit(BINS - 1)).cast("int")
    bins = seen.withColumn("bin", place).groupBy("node", "goal", "bin").agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min("tie").alias("tie"), F.max("tie").alias("last"))
    upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hit = bins.withColumn("upto", F.sum("w").over(upto)).filter(F.col("upto") >= F.col("goal"))
    return {r.node: r.r for r in hit.groupBy("node").agg(F.min_by(F.struct("lo", "hi", "w", "upto", "tie", "last"), "bin").alias("r")).collect()}


def _medians(rows: DataFrame, wanted: dict[int, tuple[int, int, int, float]]) -> dict[int, tuple[int, int, int]]:
    """For each node its cut (dimension, x, tie): rows up to it go to the left.

    wanted: node -> (dimension, its least and greatest value, weight to the left). In the order of (x, tie) the cut is the first row at
    which the weights sum to the wanted one, or the one before it if less than half of the row's weight lies
    below and there is one. Rows that are equal in both are one. A look sums the weights of equal bins of the open bracket by partial aggregation and goes on
    inside the bin that holds the median, first by value, then by the ties of one value, until a bin is one
    value.
    """
    open_ = {n: {"dim": d, "at": None, "lo": lo, "hi": hi, "goal": goal, "before": 0} for n, (d, lo, hi, goal) in wanted.items()}
    cuts = {}
    while open_:
        found = _heavy_bins(rows, [(n, s["dim"], s["at"], s["lo"], s["hi"], float(s["goal"])) for n, s in open_.items()])
        for n, r in found.items():
            s = open_[n]
            s["goal"] -= r.upto - r.w
            s["before"] += r.upto - r.w
            if r.lo < r.hi:
                s["lo"], s["hi"] = r.lo, r.hi
            elif r.tie < r.last:
                s |= {"at": r.lo, "lo": r.tie, "hi": r.last}
            else:
                cuts[n] = (s["dim"], r.lo if s["at"] is None else s["at"], r.tie if s["goal"] >= r.w / 2 or not s["before"] else r.tie - 1)
                del open_[n]
    return cuts


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """Put each row of docs (doc_id, text, source, lang) into a leaf of a k-d tree over its metadata.

    A node is split at the weighted median (weights: UTF-8 bytes of the text plus 1) along its widest
    dimension (range within the node over range of all rows: doc_id, log of bytes, ranks of source and of
    language among all values) until there are ``shards`` leaves, or until each leaf has ``target_bytes``
    or less. Equal values are split by a hash of the row, so sizes come out near equal even where one value
    holds most rows; rows that also share doc_id and text stay together, so a leaf of such rows only, or of
    one long text, may be above the target. Nulls sort before all values; null text weighs 1; empty input:
    no rows. A null doc_id counts as -1 there. Leaves that come out empty, for want of rows, leave their number unused.

    Returns ``row`` (the input row as a struct), size, text_crc32, shard (0-based) and slot (0-based,
    gapless within the shard, by a hash of the row).
    """
    rows = _measured(docs)
    light = written(rows.drop("row", "text_crc32"), "kd")
    for c, out in (("_source", "x2"), ("_lang", "x3")):
        ranks = _ranks(light, c)
        many = ranks.count()
        light, rows = (_ranked(t, c, ranks, many, out) for t in (light, rows))
    light = written(light, "kd-ranked").withColumn("node", F.lit(1).cast("long"))
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    ends = [f(f"x{i}").alias(f"{side}{i}") for i in range(len(DIMENSIONS)) for f, side in ((F.min, "lo"), (F.max, "hi"))]
    width = lambda r: [float(r[f"hi{i}"]) - float(r[f"lo{i}"]) if r["lo0"] is not None else 0.0 for i in range(len(DIMENSIONS))]
    extent = width(light.agg(*ends).first())
    # the tree in order of its leaves: node -> leaves still to make (shards), or None where bytes decide
    leaves: dict[int, int | None] = {1: max(1, shards or 1) if target_bytes is None else None}
    while True:
        per = light.groupBy("node").agg(F.sum("size").alias("w"), *ends).collect()
        wanted, left = {}, {}
        for r in per:
            n = leaves.get(r.node, 1) or (math.ceil(r.w / target_bytes) if target_bytes else 1)
            if n > 1:
                wide = [w / e if e else 0.0 for w, e in zip(width(r), extent, strict=True)]
                d = wide.index(max(wide))
                wanted[r.node], left[r.node] = (d, r[f"lo{d}"], r[f"hi{d}"], r.w * (n // 2) / n), n
        if not wanted:
            break
        cuts = [(n, *c) for n, c in _medians(light, wanted).items()]
        right = (_x("_dim") > F.col("_x")) | ((_x("_dim") == F.col("_x")) & (F.col("tie") > F.col("_t")))
        went = F.when(F.col("_dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + right.cast("int"))
        cut = _sent(light.sparkSession.createDataFrame(cuts, "node long, _dim int, _x long, _t long"), len(cuts))
        light, rows = (t.join(cut, "node", "left").withColumn("node", went).drop("_dim", "_x", "_t") for t in (light, rows))
        for n, *_ in cuts:
            k = left[n]
            leaves.pop(n, None)
            leaves |= {2 * n: k // 2, 2 * n + 1: k - k // 2} if target_bytes is None else {2 * n: None, 2 * n + 1: None}
        if target_bytes is not None:
            # a node whose rows all went to one side can't be split: its only child is a leaf
            sides = {r.node for r in light.select("node").distinct().collect()}
            leaves |= {n: 1 for n in leaves if n in sides and n > 1 and n ^ 1 not in sides}
    # leaves in order from left to right: by their path, read as binary digits
    order = sorted(leaves, key=lambda n: bin(n)[3:])
    first, at = [], 0
    for n in order:
        first.append((n, at))
        at += leaves[n] or 1
    place = light.sparkSession.createDataFrame(first, "node long, shard int")
    total = light.agg(F.sum("size")).first()[0] or 0
    # the rows of a shard are put in order in parts, of about 32 MB of texts over all shards
    parts = min(1 << 20, max(64, total >> 25))
    rows = rows.join(_sent(place, len(first)), "node").withColumn("_b", F.floor(F.col("tie") * (parts / float(1 << 40))))
    return running(rows, ["shard"], "_b", ["tie", "text_crc32"], F.lit(1), "slot").select("row", "size", "text_crc32", "shard", (F.col("slot") - 1).cast("long").alias("slot"))
