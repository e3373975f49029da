"""An inverted file of vectors: every row in the list of its nearest centroid, queries against a few lists each.

The exact search (retrieve.dense_topk) stays the measure: how many lists a query looks into is chosen by recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .alike import flat
from .retrieve import dense_topk, top

#: Rows that centroids are fitted on at most (those of the least hash of their id), rounds of fitting, lists at most.
SAMPLE, ROUNDS, MOST_LISTS = 65_536, 12, 4096
#: Rows of a list and queries of a list that meet in one task at most; larger ones are dealt over several.
ROWS, QUERIES = 20_000, 1024
#: Scores, and queries beside their lists, that a task holds at once.
SCORES, ASKED = 2_000_000, 8192


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as unit rows; missing components are zeros, null vectors too."""
    if column.null_count == 0 and (column.value_lengths().to_numpy() == width).all():
        values = flat(column)[0]
        return unit(np.nan_to_num(values.astype(np.float64)).reshape(len(column), width))
    out = np.zeros((len(column), width))
    for i, v in enumerate(column.to_pylist()):
        v = np.array([x or 0.0 for x in v or []][:width])
        out[i, : len(v)] = v
    return unit(out)


def lists_of(m: np.ndarray) -> pa.Array:
    """Rows as a column of vectors."""
    if not m.size:
        return pa.array([[]] * len(m), pa.list_(pa.float64()))
    return pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))


def fit(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids (unit rows) of unit rows: begun at rows spread evenly over the sample, moved to their rows' mean direction."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(sample, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        there = np.bincount(own, minlength=len(centroids)) > 0
        centroids[there] = unit(sums[there])
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, best first."""
    out = np.zeros((len(rows), k), np.int64)
    step = max(1, SCORES // len(centroids))
    for at in range(0, len(rows), step):
        s = rows[at : at + step] @ centroids.T
        first = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)[:, :k]
        order = np.argsort(-np.take_along_axis(s, first, 1), axis=1, kind="stable")
        out[at : at + step] = np.take_along_axis(first, order, 1)
    return out


def probed(ids: pa.Array, m: np.ndarray, centroids: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """(list, query_id, vector): queries beside each of their nearest lists. A query's vector goes to each of its lists, so
    this comes in pieces of ASKED rows, or one query."""
    step = max(1, ASKED // probes)
    for at in range(0, len(m), step):
        own = m[at : at + step]
        near, who = nearest(own, centroids, probes), np.repeat(np.arange(len(own)), probes)
        yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), ids.take(pa.array(at + who)), lists_of(own[who])], ["list", "query_id", "vector"])


@dataclass(frozen=True)
class InvertedFile:
    """Rows (list, id, vector) in the shared folder, their centroids, and how many lists a query looks into."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int = 1


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> InvertedFile:
    """The inverted file of vectors (id, vector): centroids of a bounded sample, every row assigned.

    ``lists`` is four times the root of the number of rows unless given, MOST_LISTS at most. Null vectors are zeros.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vector")
    some = rows.filter("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    width = pc.max(pc.list_value_length(some.column("vector"))).as_py() or 0
    n = rows.count() if lists is None else 0
    lists = min(lists or max(1, round(4 * n**0.5)), MOST_LISTS)
    found = fit(matrix(some.column("vector").combine_chunks(), width), lists) if some.num_rows else np.zeros((1, width))
    sent = spark.sparkContext.broadcast(found)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("vector"), sent.value.shape[1])
            own = nearest(m, sent.value, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("id"), lists_of(m)], ["list", "id", "vector"])

    return InvertedFile(written(rows.mapInArrow(assign, "list int, id long, vector array<double>"), "inverted-file"), found)


def search(file: InvertedFile, queries: DataFrame, k: int = 96) -> DataFrame:
    """(query_id, id, score, rank): the k best rows for each query (query_id, vector) in the lists nearest to it, ties by id.

    All queries go together: one scan of the file, whose rows meet their list's queries. Lists of many rows or queries are
    dealt over tasks, so each multiplies blocks of bounded size and keeps k rows for each query.
    """
    spark = queries.sparkSession
    sent, probes = spark.sparkContext.broadcast(file.centroids), min(file.probes, len(file.centroids))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from probed(batch.column("query_id"), matrix(batch.column("vector"), sent.value.shape[1]), sent.value, probes)

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").mapInArrow(ask, "list int, query_id long, vector array<double>")
    asked = written(asked, "probes")
    sizes = file.rows.groupBy("list").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_parts"))
    loads = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_blocks"))
    cells = F.broadcast(written(sizes.join(loads, "list"), "cells"))  # a row per list, MOST_LISTS at most
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    # both sides' keys have one type: equal numbers of other types are dealt to other tasks, where they don't meet
    one = lambda name, c: F.pmod(F.xxhash64(name), F.col(c)).cast("int")
    left = file.rows.join(cells, "list").withColumn("part", one("id", "_parts")).withColumn("block", every("_blocks")).select("list", "part", "block", "id", "vector")
    right = asked.join(cells, "list").withColumn("block", one("query_id", "_blocks")).withColumn("part", every("_parts")).select("list", "part", "block", "query_id", "vector")
    width = file.centroids.shape[1]

    def meet(rows: pa.Table, own: pa.Table) -> pa.Table:
        ids, names = rows.column("id").to_numpy(), own.column("query_id").to_numpy()
        m, q = (flat(t.column("vector"))[0].reshape(t.num_rows, width) for t in (rows, own))
        out = []
        for at in range(0, len(names), 64):
            s = np.round(q[at : at + 64] @ m.T, 9)
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
            i, j = np.nonzero(s >= least[:, None])
            order = np.lexsort((ids[j], -s[i, j], i))
            i, j = i[order], j[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[keep], j[keep]
            out.append(pa.table({"query_id": names[at + i], "id": ids[j], "score": s[i, j]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    key = ["list", "part", "block"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, "query_id long, id long, score double")
    return top(met, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours (query_id, id) that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("_found", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("_found", F.lit(0))), F.lit(1.0))).first()[0]


def calibrated(file: InvertedFile, vectors: DataFrame, queries: DataFrame, k: int = 96, target: float = 0.95) -> InvertedFile:
    """The file with the fewest lists per query (of 1, 2, 4, ...) that reach a recall on some queries (query_id, vector; a
    bounded sample is the caller's choice), measured against the exact search."""
    queries = written(queries, "calibration")
    exact = written(dense_topk(queries, vectors, k), "exact")
    probes = 1
    while probes < len(file.centroids) and recall(search(replace(file, probes=probes), queries, k), exact) < target:
        probes *= 2
    return replace(file, probes=min(probes, len(file.centroids)))
