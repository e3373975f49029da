"""Sparse top k with upper bounds: postings in blocks of like weight, of which only those that can matter are scored.

A block holds postings of one term whose weights lie close together, and a part of them if they are many; its head has their
number and largest weight. The result is that of retrieve.sparse_topk().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import SENT, sent, written
from .retrieve import idf, top

#: Steps of weight by which a term's postings are told apart; postings of a block at most, about.
STEP, BLOCK = 0.05, 4096
#: Postings per query that a first look scores for a lower bound, in units of k.
LOOK = 40
#: Scores within this of the bound are kept; whole scores are rounded to nine places.
SLACK = 1e-7


@dataclass(frozen=True)
class Blocks:
    """postings: idx, level, part, id, weight. heads: idx, level, parts, n, most. terms: idx, idf."""

    postings: DataFrame
    heads: DataFrame
    terms: DataFrame


@dataclass(frozen=True)
class Hits:
    """The best of each query, and how many postings were scored, of how many that the queries' terms have."""

    rows: DataFrame
    scored: int
    all: int


def build(postings: DataFrame, documents: int) -> Blocks:
    """Blocks of postings (id, idx, weight; weights are positive). Sizes come from counts by (term, level), so no term's
    postings are sorted or gathered."""
    levelled = postings.select("id", "idx", "weight", F.floor(F.col("weight") / STEP).cast("int").alias("level"))
    heads = levelled.groupBy("idx", "level").agg(F.count("*").alias("n"), F.max("weight").alias("most"))
    heads = written(heads.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int")), "heads")
    # one in BLOCK postings at most has a row here
    several = sent(heads.filter("parts > 1").select("idx", "level", "parts"), "several")
    placed = levelled.join(several, ["idx", "level"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    return Blocks(written(placed.select("idx", "level", "part", "id", "weight"), "blocks"), heads, written(idf(postings, documents), "terms"))


def _scored(chosen: DataFrame, blocks: Blocks) -> DataFrame:
    """(query_id, id, score): sums over the chosen blocks (query_id, idx, level, parts, c)."""
    chosen = written(chosen.select("query_id", "idx", "level", "parts", "c"), "chosen")
    if chosen.count() <= SENT:  # the postings stay where they are, so their parts don't matter
        met = blocks.postings.join(F.broadcast(chosen.drop("parts")), ["idx", "level"])
    else:
        parts = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = blocks.postings.join(parts.select("query_id", "idx", "level", F.col("part").cast("long").alias("part"), "c"), ["idx", "level", "part"])
    return met.groupBy("query_id", "id").agg(F.sum(F.col("c") * F.col("weight")).alias("score"))


def search(queries: DataFrame, blocks: Blocks, k: int = 96) -> Hits:
    """The k best (query_id, id, score, rank) of queries (query_id, idx, weight), as sparse_topk() has them.

    A first look at each query's blocks of the highest bounds gives a score that its k-th best document reaches. A block
    is then left out if its bound and the other terms' highest ones together stay below: no document that counts has a
    posting in it. Terms whose highest bounds together stay below as well bring no document in; of their postings only
    those of documents that others brought in are scored.
    """
    asked = queries.select("query_id", "idx", F.col("weight").alias("q")).join(blocks.terms, "idx").withColumn("c", F.col("q") * F.col("idf"))
    heads = asked.select("query_id", "idx", "c").join(blocks.heads, "idx").withColumn("bound", F.col("c") * F.col("most"))
    heads = written(heads, "asked")
    # a row per block of a query's terms; a query has as many terms as its text has words
    best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "idx", "level").rowsBetween(Window.unboundedPreceding, -1)
    look = heads.withColumn("before", F.coalesce(F.sum("n").over(best_first), F.lit(0))).filter(F.col("before") < k * LOOK)
    reached = top(_scored(look, blocks), k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
    reached = reached.select("query_id", F.when(F.col("found") >= k, F.col("least") - SLACK).otherwise(F.lit(-1.0)).alias("least"))
    highest = heads.groupBy("query_id", "idx").agg(F.max("bound").alias("highest"))
    low_first = Window.partitionBy("query_id").orderBy("highest", "idx").rowsBetween(Window.unboundedPreceding, 0)
    bounds = highest.withColumn("upto", F.sum("highest").over(low_first)).withColumn("all", F.sum("highest").over(Window.partitionBy("query_id")))
    marked = heads.join(bounds, ["query_id", "idx"]).join(reached, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
    kept = marked.filter(F.col("bound") + F.col("all") - F.col("highest") >= F.col("least"))
    kept = written(kept.select("query_id", "idx", "level", "parts", "n", "c", (F.col("upto") >= F.col("least")).alias("essential")), "kept")
    first = written(_scored(kept.filter("essential"), blocks), "candidates")
    rest = kept.filter("NOT essential")
    asked = sent(rest.select("query_id", "idx", "level", "c").distinct(), "rest")
    more = blocks.postings.join(asked, ["idx", "level"]).join(first.select("query_id", "id"), ["query_id", "id"])
    more = written(more.select("query_id", "id", (F.col("c") * F.col("weight")).alias("score")), "more")
    whole = first.unionByName(more).groupBy("query_id", "id").agg(F.sum("score").alias("score"))
    scored = (kept.filter("essential").agg(F.sum("n")).first()[0] or 0) + more.count()
    return Hits(top(whole.withColumn("score", F.round("score", 9)), k), scored, heads.agg(F.sum("n")).first()[0] or 0)
