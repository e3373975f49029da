"""Syndication clusters: texts whose five-token shingles are alike, and their components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..storage import sent, written
from .alike import alike_groups, alike_pairs

PERMUTATIONS, THRESHOLD, SHINGLE = 128, 0.8, 5
#: Bands of the signature; 32 of 4 rows find a pair of likeness 0.8 with probability 1 - 5e-8.
BANDS = 32
#: The least prime over 2^32.
PRIME = 4294967311
#: Members of a set that are hashed at once.
BLOCK = 512


def low_digest(shingle: Column) -> Column:
    """The first 32 bits of a shingle's MD5."""
    return F.conv(F.substring(F.md5(shingle), 1, 8), 16, 10).cast("long")


def shingles(text: Column, n: int = SHINGLE, digest: Callable[[Column], Column] = F.xxhash64) -> Column:
    """Distinct hashes of n successive tokens; all tokens as one shingle if there are fewer; none without tokens."""

    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: digest(F.array_join(F.slice(t, i, F.lit(n)), " ")))
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(many))

    return F.element_at(F.transform(F.array(tokenize(text)), of), 1)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are alike. Sizes are joined first: pairs whose sizes don't fit never meet their sets."""
    sizes = sets.select("id", F.size("s").alias("n"))
    for c, n in (("a", "m"), ("b", "n")):
        pairs = pairs.join(sizes.select(F.col("id").alias(c), F.col("n").alias(n)), c)
    fit = pairs.filter(F.least("m", "n") >= F.greatest("m", "n") * threshold - 1e-9).select("a", "b")
    fit = written(fit, "fitting")
    # sets without a pair stay where they are
    held = sets.join(sent(fit.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired"), "id", "left_semi")
    left, right = (held.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")
    both = fit.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.withColumn("jaccard", common / (F.size("s_a") + F.size("s_b") - common)).filter(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def similar_pairs(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs a < b of texts (id, text; ids distinct) whose shingle sets are that alike."""
    return similar_sets(texts.select("id", shingles(F.col("text")).alias("s")), threshold)


def similar_sets(sets: DataFrame, threshold: float, short: bool = False) -> DataFrame:
    """(a, b, jaccard) of all pairs a < b of sets (id: long, s: array of long) with Jaccard likeness ``threshold`` or more.

    alike_pairs() finds those that may be alike by keys, sizes and parities, so few others are compared in full. ``short``:
    sets of some ten members, most of them frequent.
    """
    sets = written(sets.filter(F.size("s") > 0), "sets")
    pairs = written(alike_pairs(sets.select(F.col("id").cast("long").alias("node"), "s"), threshold, short), "pairs")
    return _verified(pairs, sets, threshold)


def coefficients(permutations: int = PERMUTATIONS) -> list[tuple[int, int]]:
    """(a, b) of the signature's affine hashes: successive values of a linear congruential generator."""
    out, x = [], 12345
    for _ in range(permutations):
        a = x = (x * 1103515245 + 12345) % 2**31
        x = (x * 1103515245 + 12345) % 2**31
        out.append((a | 1, x))
    return out


def least_hashes(members: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Signature of a shingle set: the least of each affine hash (a * h + b) mod PRIME over the members' low 32 bits."""
    a, b = _coefficients(permutations)
    low, prime, out = members.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF), np.uint64(PRIME), None
    # blocks stay in the processor's cache, and a division by one number is faster than a remainder
    for at in range(0, max(len(low), 1), BLOCK):
        x = a[:, None] * low[at : at + BLOCK] + b[:, None]
        least = (x - x // prime * prime).min(1)
        out = least if out is None else np.minimum(out, least)
    return out.astype(np.int64)


@lru_cache(maxsize=4)
def _coefficients(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(x, dtype=np.uint64) for x in zip(*coefficients(permutations), strict=True))


def minhash(s: Column, permutations: int = PERMUTATIONS) -> Column:
    """least_hashes() of a column of shingle sets, none of them empty."""

    @F.pandas_udf("array<long>")
    def signature(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in sets:
            yield pd.Series([least_hashes(np.asarray(x), permutations) for x in batch])

    return signature(s)


def minhash_pairs(texts: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """Pairs that share a band of their signatures, verified by the sets' true likeness."""
    sets = written(texts.select("id", shingles(F.col("text")).alias("s")).filter(F.size("s") > 0), "shingles")
    rows = PERMUTATIONS // bands
    signed = sets.select("id", minhash(F.col("s")).alias("m"))
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(F.col("m"), i * rows + 1, F.lit(rows))))
    banded = written(signed.select("id", F.explode(keys).alias("k")), "bands")
    pairs = banded.select("k", F.col("id").alias("a")).join(banded.select("k", F.col("id").alias("b")), "k").filter("a < b").select("a", "b").distinct()
    return _verified(pairs, sets, threshold)


def clusters(texts: DataFrame) -> DataFrame:
    """(id, root): each text's cluster, named by its smallest id: components of likeness THRESHOLD or more.

    Texts with equal shingles are one node, so copies are never paired. Texts without tokens stand alone.
    """
    sets = written(texts.select("id", shingles(F.col("text")).alias("s")).withColumn("node", F.xxhash64(F.array_sort("s"))), "shingles")
    held = sets.filter(F.size("s") > 0)
    roots = alike_groups(held.select("node", "s"), THRESHOLD)
    named = held.select("id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("id").alias("first"))
    alone = sets.filter(F.size("s") == 0).select("id", F.col("id").alias("root"))
    return named.join(first, "root").select("id", F.col("first").alias("root")).unionByName(alone)
