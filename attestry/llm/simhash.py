"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alike import alike_groups, deal_hot, runs_of, span_runs
from ..operators.graph import components
from ..storage import written
from .common import row_key, small_batches

#: A-Z in lower case and all word separators as spaces; fixed values of the fingerprint's definition.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
#: Shingles whose bits are added up at once.
SLICE = 1 << 15
#: Reference fingerprints, and the bit blocks over which distances are also kept.
PIVOTS, BLOCKS = 24, 6
#: A bucket with more fingerprints is dealt over pairs of parts.
HOT = 20_000
#: Ids that are sent to every task, at most (16 bytes each, or half as many of 32).
BROADCAST_IDS = 1_000_000
#: Bits in which candidates of the 128-bit fingerprints differ at most, and their references: fixed ones and those
#: taken from the bucket itself.
MOST, FIXED_PIVOTS, OWN_PIVOTS = 44, 4, 8
#: Words and sets that a worker remembers before it starts anew.
MEMO = 200_000
ROLL = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = 3) -> np.uint64:
    """SimHash of a text: a bit is set if it is set in over half of the shingles' hashes (XXH64, seed 42), repeats
    included. Fewer words are one shingle; no words: zero."""
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return np.uint64(0)
    if len(words) <= shingle:
        line, cuts = b" ".join(words), [(0, None)]
    else:
        line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
        cuts = list(zip([0, *ends[:-shingle].tolist()], (ends[shingle - 1 :] - 1).tolist(), strict=True))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(cuts), SLICE):
        h = np.array([xxhash.xxh64_intdigest(line[a:b], 42) for a, b in cuts[i : i + SLICE]], dtype="<u8").view(np.uint8)
        ones += np.unpackbits(h.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(cuts), bitorder="little").view("<u8")[0]


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Add fp, the fingerprint of text as a long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", simhash(F.col("text")))


def references(width: int, n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed pseudo-random numbers of width words."""
    return np.random.default_rng(64).integers(0, 2**64, (n, width), dtype=np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, by rows."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot, one row per pivot."""
    return np.stack([distance(fps, p) for p in pivots])


def block_masks(most: int = 3, blocks: int = BLOCKS) -> list[tuple[int]]:
    """Masks for 64-bit fingerprints: each choice of all but ``most`` blocks. Two fingerprints within
    ``most`` bits differ in so many blocks at most, so they are equal under one mask."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [(sum(chosen),) for chosen in combinations(masks, blocks - most)]


def _signed(mask: int) -> int:
    return mask - ((mask >> 63) << 64)


def discards(table: np.ndarray, fps: np.ndarray, most: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The test of a pivot distance table on pairs of rows: pairs whose distances to any reference differ by over
    ``most`` go, the survivors are verified bit by bit."""

    def within(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = int(j[0] - i[0])
        for coordinates in table:
            if not len(i):
                return i
            i = i[np.abs(coordinates[i] - coordinates[i + step]) <= most]
        return i[distance(fps[i], fps[i + step]) <= most]

    return within


def own_references(run: np.ndarray, fps: np.ndarray, n: int) -> np.ndarray:
    """Distances of each fingerprint to ``n`` fingerprints of its own run, evenly spaced; one row per reference.

    Fixed references discard little where ``most`` is large: unrelated fingerprints lie about as far from any of
    them. One inside a group of copies tells the group from all else.
    """
    edge = np.nonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))[0]
    start, size = np.repeat(edge[:-1], np.diff(edge)), np.repeat(np.diff(edge), np.diff(edge))
    return np.stack([distance(fps, fps[start + size * k // n]) for k in range(n)])


def link_runs(keys: np.ndarray, fps: np.ndarray, most: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions) of fingerprints within ``most`` bits within runs of equal keys; keys are sorted."""
    return span_runs(keys, discards(pivot_table(fps, pivots), fps, most))


def similar(prints: DataFrame, masks: list[tuple], most: int, pivots: int = PIVOTS, hot: int = HOT) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints are within ``most`` bits and equal under one of the masks, so
    many of them that they leave the same components as all such links.

    prints: node and fp, or node, fp and fp2; fingerprints distinct. To the pivot table belong distances to
    the reference fingerprints 0 and 1, 2, 4, ... of the bits of a mask, counted over these bits alone. They
    are all equal for two fingerprints just if the bits are, so a bucket's key packs them as the bits under
    the mask. Within a bucket the distances to the other references discard pairs by their largest
    coordinate difference, and survivors are verified. A bucket of over ``hot`` fingerprints is split into
    parts that meet two by two, so no task gathers it and none of its pairs is left out.
    """
    names = [c for c in ("fp", "fp2") if c in prints.columns]
    keys = [F.struct(F.lit(i).alias("k"), F.xxhash64(*[F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(names, mask, strict=True)]).alias("key")) for i, mask in enumerate(masks)]
    spread = prints.select("node", *names, F.explode(F.array(*keys)).alias("z")).select("z.k", "z.key", "node", *names)
    dealt = deal_hot(spread, ["k", "key"], hot)
    refs = references(len(names), pivots)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, rows in runs_of(batches, ["k", "key", "cell", "node", *names], 3):
            a, b = link_runs(run, np.ascontiguousarray(rows[:, 4:]).view(np.uint64), most, refs)
            yield pa.RecordBatch.from_arrays([pa.array(rows[a, 3]), pa.array(rows[b, 3])], schema=schema)

    spark = prints.sparkSession
    small_batches(spark, 20_000)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "k", "key", "cell").sortWithinPartitions("k", "key", "cell").select("k", "key", "cell", "node", *names).mapInArrow(join, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, most: int = 3, shingle: int = 3) -> DataFrame:
    """Put each row of docs (doc_id, text, other columns) into its group of near-duplicates.

    Two rows are linked if their fingerprints differ in ``most`` bits or fewer; a group is a connected
    component. Null or wordless text has fingerprint 0 and is linked like any other. Rows with equal
    fingerprints are one node, so copies are never expanded into pairs. Repeated rows are kept; a group
    without any doc_id has component_id null. Empty input: no rows.

    Returns ``row`` (the input row as a struct), fp, component_id (the group's smallest doc_id).
    """
    return group(with_fingerprint(docs.select(F.struct("*").alias("row"), "doc_id", "text"), shingle).drop("text"), block_masks(most), most).select("row", "fp", "component_id")


def group(prints: DataFrame, masks: list[tuple], most: int) -> DataFrame:
    """Add component_id to rows that have doc_id and fp. Fingerprints without links stand alone."""
    prints = written(prints.withColumn("node", F.col("fp")), "fingerprints")
    firsts = written(prints.groupBy("node", "fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(similar(firsts.drop("first"), masks, most))
    named = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(groups, "root").select("node", "component_id"), "node").drop("node")


class Shingles:
    """Turns texts into sets of shingle hashes: words are hashed once, shingles are rolled from these."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def of(self, text: str | None) -> np.ndarray:
        """Distinct hashes of n successive words, ascending; of all words if there are fewer; none without words."""
        words, known = (text or "").encode().translate(FOLD).split(), self.known
        if not words:
            return np.zeros(0, np.int64)
        if len(known) > MEMO:
            known.clear()
        h = np.array([i if (i := known.get(w)) is not None else known.setdefault(w, xxhash.xxh64_intdigest(w, 42)) for w in words], np.uint64)
        n = min(self.n, len(words))
        out = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mixed(out * ROLL + h[k : len(h) - n + 1 + k])
        return np.unique(out.view(np.int64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def print_of_set(members: np.ndarray) -> np.ndarray:
    """128-bit SimHash of a set of 64-bit hashes, as two longs: a bit is set if it is in over half of them."""
    h = members.view(np.uint64)
    ones = np.zeros(128, np.int64)
    for i in range(0, len(h), SLICE):
        both = np.stack([h[i : i + SLICE], _mixed(h[i : i + SLICE] + ROLL)], 1)
        ones += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")


def shingle_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """key, doc_id, node, fp, fp2, s of each row of docs (doc_id, text): which row it is (see row_key), a hash of
    its set of shingles, the set's 128-bit fingerprint, and the set, null where the task has given it already."""
    spark = docs.sparkSession
    small_batches(spark)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingles(shingle), {}
        for batch in batches:
            nodes, prints, out = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles.of(text)
                node = xxhash.xxh3_64_intdigest(s.tobytes(), 5)
                if (known := seen.get(node)) is None:
                    if len(seen) > MEMO:
                        seen.clear()
                    known = seen[node] = print_of_set(s)
                    out.append(s)
                else:
                    out.append(None)
                nodes.append(node - (node >> 63 << 64))
                prints.append(known)
            p = np.array(prints, np.int64).reshape(-1, 2)
            columns = [batch.column("key"), batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(out, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "node", "fp", "fp2", "s"])

    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(sets, "key binary, doc_id long, node long, fp long, fp2 long, s array<long>")


def alike_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = MOST) -> DataFrame:
    """(key, doc_id, root) of each row of docs (doc_id, text): the group of near-duplicates it is in.

    Rows are linked if their sets of ``shingle`` words have a Jaccard likeness of ``similarity`` or more, and
    all rows without words are linked with each other; a group is a connected component. Texts with equal sets
    are one node. Candidates share one of a set's rarest shingles, so they grow with the rows and not with
    their square; among them pivot distance tables over 128-bit SimHash fingerprints discard pairs, and those
    within ``most`` bits are verified on the whole sets. A pair at 0.8 differs in 24 bits or fewer on average
    (the most is that of sets of four and five), with a deviation of under 4.5, so the radius of 44 misses one
    at that likeness with a probability under 1e-5. ``most=128`` is exact: nothing but sizes and sets decide.
    """
    sets = written(shingle_sets(docs, shingle), "sets")

    def sieve(run: np.ndarray, fps: np.ndarray):
        fps = np.ascontiguousarray(fps).view(np.uint64)
        table = np.concatenate([pivot_table(fps, references(2, FIXED_PIVOTS)), own_references(run, fps, OWN_PIVOTS)])
        return discards(table, fps, most)

    found = alike_groups(sets.filter("s IS NOT NULL").select("node", "s", "fp", "fp2"), similarity, ["fp", "fp2"], sieve if most < 128 else None)
    found = written(found, "roots")
    return sets.select("key", "doc_id", "node").join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = MOST) -> DataFrame:
    """The rows of docs (doc_id, text, any other columns) but for near-duplicates: one row of each group stays.

    Groups are those of alike_texts. Of a group the row with the smallest doc_id stays (null last, ties by a
    hash of id and text; of rows equal in both one, by a hash of all columns). Rows without a doc_id take part;
    different texts under one doc_id are rows of their own. Of all null, empty and wordless texts one stays.
    Very long texts are read whole. Empty input: no rows.
    """
    grouped = written(alike_texts(docs, shingle, similarity, most), "groups")
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")).alias("best"), F.count("*").alias("rows")).filter("rows > 1")
    best = written(best.select("root", F.col("best.key").alias("kept"), "rows"), "kept")
    gone = written(grouped.join(F.broadcast(best) if best.count() <= BROADCAST_IDS // 2 else best, "root").filter("key <> kept").select(F.col("key").alias("_gone")).distinct(), "gone")
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("_own"))
    left = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS // 2 else gone, F.col("_own") == F.col("_gone"), "left_anti")
    twice = written(grouped.groupBy("key").count().filter("count > 1").select("key"), "twice")
    if not twice.isEmpty():
        twice = twice.withColumnRenamed("key", "_twice")
        left = left.join(F.broadcast(twice) if twice.count() <= BROADCAST_IDS // 2 else twice, F.col("_own") == F.col("_twice"), "left")
        several = left.filter("_twice IS NOT NULL").groupBy("_own").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        left = left.filter("_twice IS NULL").select("row").unionByName(several.select("row"))
    return left.select("row.*")
