"""How filters interact: what each removes, alone and after others, in every order.

Texts are routed by fingerprint to tell repeated ones; each document becomes a mask of the filters that it fails, and
what any order of the filters removes follows from how often each mask occurs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, permutations

import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: The bit of the filter against repeated texts.
REPEATED = 1 << FILTERS.index("E")
UPPER, SIGNS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"
#: Stands for a missing id: later than all others.
LAST = 2**63 - 1
#: A task holds packed texts of about so many bytes before it hands them on.
HELD = 16 << 20
#: Bytes of text for each routed partition; what it holds in memory is one chain, so this bounds the sort only.
ROUTED = 128 << 20

STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failed(text: bytes) -> int:
    """Mask of the filters that a text fails by itself: too few words, too repetitive, too many capitals, signs."""
    words = text.split()  # splits bytes at \x20 and \x09 to \x0D
    capitals, chars = len(text) - len(text.translate(None, UPPER)), len(text.decode())
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 2 * chars) << 2 | (len(text) != len(text.translate(None, SIGNS))) << 3


class Chains:
    """Texts by fingerprint: texts whose fingerprints collide stand in one chain, told apart by the whole (packed) text.

    Of each text the smallest id is kept, with the number of its rows by (part, mask); rows of other ids repeat it.
    """

    def __init__(self) -> None:
        self.chains: dict[int, list] = {}
        self.size = 0

    def add(self, fingerprint: int, packed: bytes, id_: int, rows: Counter) -> tuple[int, Counter] | None:
        """The id and rows that are now known not to be the smallest, if any."""
        chain = self.chains.setdefault(fingerprint, [])
        for entry in chain:
            if entry[0] == packed:
                if id_ == entry[1]:
                    entry[2].update(rows)
                    return None
                if id_ > entry[1]:
                    return id_, rows
                gone = entry[1], entry[2]
                entry[1:] = id_, rows
                return gone
        chain.append([packed, id_, rows])
        self.size += len(packed) + 300
        return None

    def taken(self) -> Iterator[tuple[int, tuple[bytes, int, Counter]]]:
        """Every text with its smallest id and that id's rows; the chains are empty afterwards."""
        for fingerprint, chain in self.chains.items():
            for entry in chain:
                yield fingerprint, tuple(entry)
        self.chains, self.size = {}, 0


def _repeats(id_: int, rows: Counter) -> Counter:
    return Counter({(part, mask | REPEATED): n for (part, mask), n in rows.items()})


def _route(rows: Iterator) -> Iterator[tuple[int, tuple]]:
    """(fingerprint, (packed text, id, rows)): of each text the smallest id that the task met. What it met besides repeats
    that one and needs no text any more; it goes by a hash of its id."""
    chains, pack, key = Chains(), zstandard.ZstdCompressor(level=1).compress, xxhash.xxh64_intdigest
    for row in rows:
        text, id_ = (row.text or "").encode(), LAST if row.doc_id is None else row.doc_id
        gone = chains.add(key(text), pack(text), id_, Counter({(row.source or "", failed(text)): 1}))
        if gone:
            yield key(str(gone[0])), (None, gone[0], _repeats(*gone))
        if chains.size > HELD:
            yield from chains.taken()
    yield from chains.taken()


def _settle(rows: Iterator) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of a partition in the order of its fingerprints: one chain at a time is held."""
    for fingerprint, group in groupby(rows, key=lambda row: row[0]):
        chains = Chains()
        for _, (packed, id_, own) in group:
            gone = (id_, own) if packed is None else chains.add(fingerprint, packed, id_, own)
            if gone:
                yield from _told(gone[0], gone[1] if packed is None else _repeats(*gone))
        for _, (_, id_, own) in chains.taken():
            yield from _told(id_, own)


def _told(id_: int, rows: Counter) -> Iterator[tuple]:
    return ((None if id_ == LAST else id_, part, mask, n) for (part, mask), n in rows.items())


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of docs (doc_id, text, source) fail which filters.

    Each task keeps the smallest id of every text that it meets (16 MB of packed texts at a time), so that a text goes to
    the partition of its fingerprint once for each task, however often it occurs; there, rows come in the order of their
    fingerprints and one chain is held. The texts are packed alike by all tasks, so equal packed texts are equal texts.

    Null texts are empty, null sources the empty string; a null id comes after all others. Rows of one id and text are no
    repeats of each other. Empty table: no rows.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // ROUTED))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source").rdd
    routed = rows.mapPartitions(_route).repartitionAndSortWithinPartitions(parts, lambda fingerprint: fingerprint)
    return spark.createDataFrame(routed.mapPartitions(_settle), "doc_id long, part string, mask int, n long", verifySchema=False)


def steps(counts: list[list[int]]) -> Iterator[tuple]:
    """What each order of the filters does at each step, from (n, good, toxic) of every mask."""
    failing = lambda bit, free, column: sum(c[column] for m, c in enumerate(counts) if m & bit and not m & free)
    total = sum(c[0] for c in counts)
    # a document that fails k filters is removed by each of them in 1 / k of the orders
    orders = math.factorial(len(FILTERS))
    shapley = [sum(c[0] * orders // m.bit_count() for m, c in enumerate(counts) if m >> i & 1) for i in range(len(FILTERS))]
    for order in permutations(range(len(FILTERS))):
        before, kept = 0, total
        for step, i in enumerate(order, 1):
            bit = 1 << i
            removed = failing(bit, before, 0)
            kept -= removed
            yield (
                "".join(FILTERS[j] for j in order), step, kept, removed, failing(bit, 0, 0) - removed, counts[bit][0],
                failing(bit, before, 1), failing(bit, before, 2), shapley[i],
            )
            before |= bit


def _vector(row: tuple) -> list[list[int]]:
    counts = [[0, 0, 0] for _ in range(1 << len(FILTERS))]
    return _with(counts, row)


def _with(counts: list[list[int]], row: tuple) -> list[list[int]]:
    for i, n in enumerate(row[1:]):
        counts[row[0]][i] += n
    return counts


def _sum(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, zeros included, of docs (doc_id, text, source) and labels
    (doc_id, quality, toxic).

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * capitals A-Z > 2 * code points; D: holds one of
    #$%&*|; E: equal to the text of a smaller id anywhere in the table. kept: after the step; removed: at it; redundant:
    fail its filter, removed earlier; unique_fails: fail its filter only; good_lost, toxic_lost: removed here with quality
    or toxic 1 in some row of labels; shapley: what its filter removes, over all orders. Null handling: see masks(); rows
    without an id have no labels. Empty table: no rows.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    lost = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    counts = masks(docs).join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), lost("good"), lost("toxic"))
    vectors = counts.rdd.map(lambda r: (r.part, (r.mask, r.n, r.good, r.toxic))).combineByKey(_vector, _with, _sum)
    rows = vectors.flatMap(lambda kv: ((kv[0], *step) for step in steps(kv[1])))
    return docs.sparkSession.createDataFrame(rows, STEPS, verifySchema=False)
