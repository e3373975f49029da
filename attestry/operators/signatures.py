"""The signature store: cluster ids for new documents against what recent documents left."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import sent, written
from .alike import deal_hot, flat, runs_of, span_runs
from .graph import components
from .near_duplicates import BANDS, PERMUTATIONS, THRESHOLD, least_hashes, low_digest, shingles

#: Days that a signature takes part in clustering.
WINDOW_DAYS = 14
#: Signatures of one band, beyond which it is dealt over pairs of parts.
HOT_BAND = 4096


def signed(sets: DataFrame) -> DataFrame:
    """(content_hash, signature, created_at) of sets (content_hash, s, created_at), batch or stream; of an empty set the
    signature is null. Shingles go from where they are made into the signature; a filter on them would make them twice."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = flat(batch.column("s"))
            found = [least_hashes(m) if len(m) else None for m in np.split(values, np.cumsum(lengths)[:-1])] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("content_hash"), pa.array(found, pa.list_(pa.int64())), batch.column("created_at")], ["content_hash", "signature", "created_at"])

    return sets.select("content_hash", "s", "created_at").mapInArrow(sign, "content_hash string, signature array<long>, created_at timestamp")


def signatures(docs: DataFrame) -> DataFrame:
    """(content_hash, signature, created_at) of docs (content_hash, text, created_at); without tokens the signature is null."""
    return written(signed(docs.select("content_hash", shingles(F.col("text"), digest=low_digest).alias("s"), "created_at")), "signatures")


def band_keys(signature: Column, bands: int = BANDS) -> Column:
    """One key for each band of a signature: its number and its values."""
    rows = PERMUTATIONS // bands
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(signature, i * rows + 1, F.lit(rows))))


def agree(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which signatures are equal in a share of ``threshold`` of their places, row by row."""
    return (a == b).mean(axis=1) >= threshold - 1e-9


def needed(threshold: float, bands: int) -> int:
    """How many of the bands two signatures that agree need at most, to have one in common: each place in which they
    differ takes one band away."""
    return min(bands, PERMUTATIONS - math.ceil(PERMUTATIONS * threshold - 1e-6) + 1)


def met(keyed: DataFrame) -> DataFrame:
    """(k, id) of the rows (k, id: longs) whose k several ids have; equal sets of ids have one k, made of their members."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, rows in runs_of(batches, ["k", "id"], 1):
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
            run, id_ = run[new], rows[new, 1]
            starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            x = id_.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
            name, keep = np.add.reduceat(x ^ (x >> np.uint64(29)), starts).view(np.int64), np.bincount(run)[run] > 1
            yield pa.RecordBatch.from_arrays([pa.array(name[run][keep]), pa.array(id_[keep])], names=["k", "id"])

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "k").sortWithinPartitions("k", "id").mapInArrow(several, "k long, id long").distinct()


def band_links(signed: DataFrame, days: int | None = WINDOW_DAYS, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(a, b): links of signatures (content_hash, signature, created_at) that share a band, agree in ``threshold`` of their
    places and are at most ``days`` apart (at any distance if it is None). They span what all such pairs would join, within each band; pairs are not listed.

    Bands hold hashes of names: two of one hash would both be compared. Signatures go to those bands only that several have,
    once for each set of members. Members of a band are compared with one another but for those that are joined already. Crowded bands
    are dealt over pairs of parts. Null signatures have no links.
    """
    held = signed.filter("signature IS NOT NULL").select(F.xxhash64("content_hash").alias("id"), F.col("content_hash").alias("node"), F.unix_seconds("created_at").alias("at"), "signature")
    keys = F.slice(band_keys(F.col("signature"), bands), 1, needed(threshold, bands))
    may = written(met(held.select(F.explode(keys).alias("k"), "id")), "met")
    # signatures that meet no other stay where they are
    known = held.join(sent(may.select("id").distinct(), "meeting"), "id", "left_semi")
    return run_links(may.join(known, "id").withColumn("fresh", F.lit(True)), None if days is None else days * 86400, threshold)


def run_links(keyed: DataFrame, span: int | None, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): spanning links of the rows (k, node, at, signature, fresh) of one k that agree and are at most ``span`` apart.
    Two that aren't fresh are not compared."""
    columns = ["k", "cell", "node", "at", "signature", "fresh"]

    def of_runs(rows: pa.Table) -> pa.RecordBatch:
        k, cell, at, fresh = (rows.column(c).to_numpy() for c in ("k", "cell", "at", "fresh"))
        run = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]) | (cell[1:] != cell[:-1]))])
        places = flat(rows.column("signature"))[0].reshape(len(k), -1)
        near = lambda i, j: i[(fresh[i] | fresh[j]) & (np.abs(at[i] - at[j]) <= (np.inf if span is None else span)) & agree(places[i], places[j], threshold)]
        left, right = span_runs(run, near)
        node = rows.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(left)), node.take(pa.array(right))], names=["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, new]) if rest is not None else new
            k, cell = (rest.column(c).to_numpy() for c in ("k", "cell"))
            other = np.flatnonzero((k != k[-1]) | (cell != cell[-1])) if len(k) else []
            if len(other):  # the last run may go on
                yield of_runs(rest.slice(0, int(other[-1]) + 1))
                rest = rest.slice(int(other[-1]) + 1)
        if rest is not None and rest.num_rows:
            yield of_runs(rest)

    dealt = deal_hot(keyed, ["k"], HOT_BAND).select(*columns)
    return dealt.repartition("k", "cell").sortWithinPartitions("k", "cell", "at", "node").mapInArrow(link, "a string, b string").distinct()


def recent(store: DataFrame, now: datetime, days: int = WINDOW_DAYS) -> DataFrame:
    """Stored signatures (content_hash, signature, created_at, cluster_id) of the last days."""
    return store.filter(F.col("created_at") >= F.lit(now) - F.make_interval(days=F.lit(days)))


def assign(new: DataFrame, store: DataFrame, now: datetime | None = None, days: int = WINDOW_DAYS, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(content_hash, signature, created_at, cluster_id) of new signatures (content_hash, signature, created_at).

    New and recent documents are linked as band_links() says, whatever their times; recent are those of the last ``days``
    before ``now``, or before the earliest new one. A new document takes the cluster of the earliest stored document in its component,
    else the first 16 digits of the hash of the component's first new one. Contents that the store holds keep their
    cluster. Null signatures stand alone.
    """
    return _grouped(new, store, now, days, threshold, bands).filter("NOT stored").select("content_hash", "signature", "created_at", F.col("group_id").alias("cluster_id"))


def merged(new: DataFrame, store: DataFrame, now: datetime | None = None, days: int = WINDOW_DAYS, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(content_hash, cluster_id) of new and recent documents: as assign() has the new ones, but clusters that a new document
    joins are one, named by the earliest stored document's."""
    return _grouped(new, store, now, days, threshold, bands).select("content_hash", F.col("group_id").alias("cluster_id"))


def _grouped(new: DataFrame, store: DataFrame, now: datetime | None, days: int, threshold: float, bands: int) -> DataFrame:
    """New and recent documents with the cluster (group_id) of their component."""
    if now is None:
        now = new.agg(F.min("created_at")).first()[0] or datetime.max
    old = recent(store, now, days).select("content_hash", "signature", "created_at", "cluster_id")
    fresh = new.join(store.select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    all_ = written(old.withColumn("stored", F.lit(True)).unionByName(fresh.select("content_hash", "signature", "created_at", F.lit(None).cast("string").alias("cluster_id"), F.lit(False).alias("stored"))), "both")
    roots = components(band_links(all_, None, threshold, bands))
    named = all_.join(roots.withColumnRenamed("node", "content_hash"), "content_hash", "left").withColumn("root", F.coalesce("root", "content_hash"))
    own = F.substring("content_hash", 1, 16)
    best = named.groupBy("root").agg(F.min_by(F.coalesce("cluster_id", own), F.struct((~F.col("stored")).alias("n"), "created_at", "content_hash")).alias("group_id"))
    return named.join(best, "root")
