"""Hard negatives: blocks of anchors are multiplied with blocks of candidates, twice.

The first pass keeps each anchor's best rows of its own label, the second its best rows of other labels inside
the window that each of these positives opens. Every row is a candidate of every anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import work_path, written

#: Anchors of one round are broadcast together; their matrix has about so many bytes at most.
ROUND_BYTES = 32 << 20
#: A product of blocks has at most so many scores (16 MB).
TILE = 1 << 21
#: Below this, sums of products of whole numbers are exact in float64.
EXACT = 2**53


def whole_numbers(column: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of floor(scale * x), which rows of the column it holds): rows that are null, or have a null or non-finite
    component, are left out; shorter vectors end in zeros. Float64 where all products are exact, else Python integers."""
    lengths = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    values = column.flatten()
    x = np.floor(np.asarray(values.cast(pa.float64()).fill_null(np.nan), dtype=np.float64) * scale)
    row = np.repeat(np.arange(len(lengths)), lengths)
    good = np.asarray(column.is_valid()).copy()
    good[row[~np.isfinite(x)]] = False
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    place = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = x
    return out[good], np.flatnonzero(good)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two blocks of whole numbers; Python integers where float64 can't hold them exactly."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < EXACT:
        return a @ b.T
    as_int = np.vectorize(int, otypes=[object])
    out = as_int(a) @ as_int(b).T
    if np.abs(out).max(initial=0) >= 2**63:
        raise OverflowError("a score does not fit in 64 bits")
    return out


class Best:
    """The k best (score, id) of each of n keys, higher scores first, ties by smaller id. Two of them merge by their rows."""

    def __init__(self, n: int, k: int):
        self.k, self.n, self.floor = k, n, np.full(n, -np.inf)
        self.key, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, first: int, block: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the keys first, first + 1, ... against ids, where allowed."""
        rows, cols = np.nonzero(allowed & (block >= self.floor[first : first + len(block), None]))
        if not len(rows):
            return
        key, score = np.concatenate([self.key, rows + first]), np.concatenate([self.score, block[rows, cols].astype(np.int64)])
        id_ = np.concatenate([self.id, ids[cols]])
        order = np.lexsort((id_, -score, key))
        key, score, id_ = key[order], score[order], id_[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        keep = rank < self.k
        self.key, self.score, self.id = key[keep], score[keep], id_[keep]
        full = rank == self.k - 1
        self.floor[key[full]] = score[full]


def _tiles(n: int, m: int) -> Iterator[tuple[int, int, int, int]]:
    """Tiles of an n by m product: (first row, last, first column, last)."""
    wide = max(1, min(m, 1024))
    high = max(1, TILE // wide)
    for j in range(0, m, wide):
        for i in range(0, n, high):
            yield i, min(n, i + high), j, min(m, j + wide)


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, matrix) of the rows that take part."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            matrix, used = whole_numbers(part.column("vector"), scale)
            yield np.asarray(part.column("id"))[used], np.asarray(part.column("label"))[used], matrix


FOUND, HARD = "key long, score long, id long", "key long, score long, id long, anchor_id long, positive_id long, positive_score long"


def _first_pass(sent, scale: float, k: int):
    """For mapInArrow: a task's k best rows of each anchor's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, anchors = sent.value
        best = Best(len(ids), k)
        for own, own_labels, matrix in _blocks(batches, scale):
            for i, last, j, end in _tiles(len(ids), len(own)):
                allowed = (labels[i:last, None] == own_labels[None, j:end]) & (ids[i:last, None] != own[None, j:end])
                best.add(i, scores(anchors[i:last], matrix[j:end]), allowed, own[j:end])
        yield pa.RecordBatch.from_pydict({"key": best.key, "score": best.score, "id": best.id})

    return run


def _second_pass(sent, windows, scale: float, k: int, low: int, high: int):
    """For mapInArrow: a task's k best rows of other labels in the window of each positive; windows: (anchor's place, score, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, anchors = sent.value
        key, score, positive = windows.value
        least, most = -((-low * score) // 100), (high * score) // 100
        best = Best(len(key), k)
        for own, own_labels, matrix in _blocks(batches, scale):
            for i, last, j, end in _tiles(len(ids), len(own)):
                block, other = scores(anchors[i:last], matrix[j:end]), labels[i:last, None] != own_labels[None, j:end]
                a, b = np.searchsorted(key, [i, last])
                for first in range(a, b, last - i):  # as many windows at a time as the tile has rows
                    w = slice(first, min(b, first + last - i))
                    s = block[key[w] - i]
                    best.add(first, s, other[key[w] - i] & (s >= least[w, None]) & (s <= most[w, None]), own[j:end])
        at = key[best.key]
        yield pa.RecordBatch.from_pydict({"key": best.key, "score": best.score, "id": best.id, "anchor_id": ids[at], "positive_id": positive[best.key], "positive_score": score[best.key]})

    return run


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The k best rows of each key from what the tasks found, with their rank."""
    by = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _columns(table: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    return tuple(np.asarray(table.column(c), dtype=np.int64) for c in names)


def mine(
    rows: DataFrame, is_anchor: Column, scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """Hard negatives of the rows (id, label, vector) for which is_anchor holds.

    A component x counts as floor(scale * x); a score is the inner product of two rows, exact (float64 products while the
    bound of a block is below 2^53, else integers; beyond 64 bits an error). Positives are the best rows of the anchor's
    label, negatives of a positive the best ones of another label with low * positive <= 100 * negative <= high * positive.
    Higher scores first, ties by smaller id.

    Anchors are dealt into rounds by a hash of their id, so that a round's matrix has about ``round_bytes`` however many
    there are; each round is broadcast and reads the candidates twice. A task keeps its best rows per anchor in all its
    blocks and hands on these only, so neither a frequent vector nor a frequent label gathers anywhere.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Missing components of shorter
    vectors are zeros. Equal anchors are one; other repeated rows are candidates each, and rows of the anchor's id are none
    of its positives. Anchors without positives, positives without negatives and empty tables give no rows.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark, path = rows.sparkSession, work_path(rows.sparkSession, "hard-negatives")
    used = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"), is_anchor.alias("_anchor"))
    used = used.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    anchors = written(used.filter("_anchor").select("id", "label", "vector").distinct(), "anchors")
    used = used.select("id", "label", "vector")
    n, width = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
    rounds = -(-n * 8 * (width or 1) // round_bytes)
    for number in range(rounds):
        own = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == number).orderBy("id", "label").toArrow()
        matrix, at = whole_numbers(pa.chunked_array(own.column("vector"), pa.list_(pa.float64())).combine_chunks(), scale)
        ids, labels = _columns(own, "id", "label")
        sent = spark.sparkContext.broadcast((ids[at], labels[at], matrix))
        found = _merged(used.mapInArrow(_first_pass(sent, scale, positives), FOUND), positives)
        windows = spark.sparkContext.broadcast(_columns(found.select("key", "score", "id", "rank").orderBy("key", "rank").toArrow(), "key", "score", "id"))
        hard = _merged(used.mapInArrow(_second_pass(sent, windows, scale, negatives, low, high), HARD), negatives)
        hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/round={number}")
        sent.destroy()
        windows.destroy()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(out).parquet(*[f"{path}/round={k}" for k in range(rounds)]) if rounds else spark.createDataFrame([], out)
