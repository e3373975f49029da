"""Retrieval: dense and sparse nearest neighbours, rank fusion, coverage, assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..storage import sent, written

#: Queries of one block: their vectors are sent to all tasks together.
QUERY_BLOCK = 2048
#: Rows that meet a block of queries at once.
ROW_BLOCK = 2048
RRF_K = 60


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 96) -> DataFrame:
    """(query_id, id, score): the k vectors of the largest cosine for each query, ties by id.

    queries: query_id, vector; vectors: id, vector. A stated query set against all rows, in blocks of
    queries: each task multiplies its rows by the block and keeps k of them for each query, and a
    window over these partial results keeps k in all. A zero vector scores 0.
    """
    spark = vectors.sparkSession
    spec, schema = "query_id long, id long, score double", pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def block(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, unit(q)))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            best = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)
            for batch in batches:
                for at in range(0, batch.num_rows, ROW_BLOCK):
                    some = batch.slice(at, ROW_BLOCK)
                    own = some.column("id").to_numpy(zero_copy_only=False)
                    m = unit(np.array(some.column("vector").to_pylist(), dtype=np.float64))
                    scores = q @ m.T
                    for i in range(len(ids)):
                        s = scores[i]
                        keep = np.nonzero(s >= np.partition(s, len(s) - k)[len(s) - k])[0] if len(s) > k else np.arange(len(s))
                        a, b = np.concatenate([best[i][0], own[keep]]), np.concatenate([best[i][1], s[keep]])
                        order = np.lexsort((a, -b))[:k]
                        best[i] = a[order], b[order]
            for i, (a, b) in zip(ids.tolist(), best, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), i)), pa.array(a), pa.array(b)], schema=schema)

        return vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(nearest, spec)

    found, ids, q = [], [], []
    for r in queries.select("query_id", "vector").toLocalIterator():
        ids.append(r[0])
        q.append(r[1])
        if len(ids) == QUERY_BLOCK:
            found.append(block(np.array(ids), np.array(q, dtype=np.float64)))
            ids, q = [], []
    if ids or not found:
        found.append(block(np.array(ids, dtype=np.int64), np.array(q, dtype=np.float64).reshape(len(ids), -1)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # whole scores decide; equal to nine places counts as a tie
    return top(out.withColumn("score", F.round("score", 9)), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, id, score) of each query, with rank; ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def idf(postings: DataFrame, documents: int) -> DataFrame:
    """(idx, idf): ln(1 + (N - n + 0.5) / (n + 0.5)) over n documents with the term."""
    return postings.groupBy("idx").agg(F.count("*").alias("n")).select("idx", F.log1p((documents - F.col("n") + 0.5) / (F.col("n") + 0.5)).alias("idf"))


def sparse_topk(queries: DataFrame, postings: DataFrame, documents: int, k: int = 96) -> DataFrame:
    """(query_id, id, score, rank): best sums of query weight, idf and document weight over common terms.

    queries: query_id, idx, weight; postings: id, idx, weight. Postings stay where they are if the queries' terms are few;
    those of a document that lie together are summed up before they are dealt.
    """
    asked = sent(queries.select("query_id", "idx", F.col("weight").alias("q")), "asked")
    held = idf(postings.join(asked, "idx", "left_semi"), documents)
    terms = sent(asked.join(held, "idx"), "terms")
    scored = postings.join(terms, "idx").groupBy("query_id", "id").agg(F.sum(F.col("q") * F.col("idf") * F.col("weight")).alias("score"))
    return top(scored.withColumn("score", F.round("score", 9)), k)


def fuse(legs: list[DataFrame], k: int = 24, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) legs: the sum of 1 / (rrf_k + rank), best k."""
    every = legs[0].select("query_id", "id", "rank")
    for leg in legs[1:]:
        every = every.unionByName(leg.select("query_id", "id", "rank"))
    scored = every.groupBy("query_id", "id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"))
    return top(scored.withColumn("score", F.round("score", 12)), k)


def covering(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits (query_id, id, ...) that share a token with their query. queries: query_id, text (expanded); docs: id, text."""
    q = queries.select("query_id", F.array_distinct(tokenize(F.col("text"))).alias("_q"))
    d = docs.join(hits.select("id").distinct(), "id", "left_semi").select("id", tokenize(F.col("text")).alias("_d"))
    return hits.join(q, "query_id").join(d, "id").filter(F.arrays_overlap("_q", "_d")).drop("_q", "_d")


def coverage(queries: DataFrame, covered: DataFrame) -> DataFrame:
    """(query_id, hits): how many hits each query has, 0 included."""
    return queries.select("query_id").join(covered.groupBy("query_id").agg(F.count("*").alias("hits")), "query_id", "left").select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"))


def assemble(hits: DataFrame, most: int = 40) -> DataFrame:
    """The best hit of each id over all queries (the earliest query on ties), the best ``most`` as S1, S2, ..."""
    best = hits.groupBy("id").agg(F.max_by(F.struct("query_id", "score"), F.struct("score", -F.col("query_id"))).alias("b")).select("id", "b.query_id", "b.score")
    few = written(best.orderBy(F.desc("score"), "id").limit(most), "evidence")
    return few.withColumn("sid", F.concat(F.lit("S"), F.row_number().over(Window.orderBy(F.desc("score"), "id"))))
