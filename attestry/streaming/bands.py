"""Near-duplicates of a stream: signatures of recent documents are the state of their bands, in event time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.graph import components
from ..operators.near_duplicates import BANDS, THRESHOLD, low_digest, shingles
from ..operators.signatures import WINDOW_DAYS, band_keys, needed, run_links, signed
from ..storage import delete, exists, written
from .session import settings

DAY_MS = 86_400_000
#: Bands are put on so many shelves, and on each into so many boxes; a shelf is what one call of the state's code has in hand, a
#: batch at a time, and a box is an entry of its state.
SHELVES, BOXES = 1024, 256
#: State that the engine must keep outside of the heap, and with several variables.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.compression": "zstd"}


#: What the state's code returns.
MET = "k long, node string, at long, fresh boolean, signature array<long>"


def typed(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows with the columns of MET."""
    return pd.DataFrame({"k": rows["k"].astype("Int64"), "node": rows["node"].astype(object), "at": rows["at"].astype(np.int64), "fresh": rows["fresh"].astype(bool), "signature": rows["signature"].astype(object)})


@dataclass
class Members:
    """Who came in which band, and when, as columns of equal length. Their signatures are in the store, each once."""

    k: np.ndarray
    at: np.ndarray
    names: np.ndarray

    @staticmethod
    def of(values: list[tuple]) -> Members:
        """The members of entries of the state."""
        k, at = np.frombuffer(b"".join(v[1] for v in values), np.int64).reshape(-1, 2).T
        names = np.array([n for v in values for n in v[0].split("\n")], dtype=object)
        return Members(k, at, names)

    def __len__(self) -> int:
        return len(self.k)

    def take(self, chosen: np.ndarray) -> Members:
        return Members(self.k[chosen], self.at[chosen], self.names[chosen])

    def values(self) -> Iterator[tuple[int, tuple]]:
        """The entries of the state: each box with its members."""
        box = boxes(self.k)
        order = np.argsort(box, kind="stable")
        held, box = self.take(order), box[order]
        cuts = [0, *(np.flatnonzero(box[1:] != box[:-1]) + 1).tolist(), len(box)] if len(box) else [0]
        pairs = np.stack([held.k, held.at], 1)
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(box[first]), ("\n".join(held.names[first:last]), pairs[first:last].tobytes())


def boxes(k: np.ndarray) -> np.ndarray:
    """The box of each band on its shelf."""
    return k // SHELVES % BOXES


def meeting(k: np.ndarray, at: np.ndarray, fresh: np.ndarray, span: int) -> np.ndarray:
    """Which members, sorted by band and time, are at most ``span`` apart from another one of their band, one of the two fresh."""
    n = np.arange(len(k))
    out = np.zeros(len(k), bool)
    for sign in (1, -1):  # the nearest one before, then the nearest one after
        own_k, own_at, own_fresh = k[::sign], at[::sign], fresh[::sign]
        last_fresh = np.maximum.accumulate(np.where(own_fresh, n, -1))
        for other in (np.where(own_fresh, n - 1, -1), np.concatenate([[-1], last_fresh[:-1]])[: len(n)]):
            some = np.flatnonzero(other >= 0)
            o = other[some]
            out[::sign][some] |= (own_k[some] == own_k[o]) & (np.abs(own_at[some] - own_at[o]) <= span)
    return out


class Bands(StatefulProcessor):
    """A shelf of bands in boxes; each box is an entry of a map, so a batch reads and writes those that it touches, all of them once.

    Returns the signatures of new members, as they come with one of their bands, and for every band that new members meet
    others in, who may be linked there: ``k`` tells such sets apart, so equal sets of several bands have one. Members
    that no row after the watermark can meet are forgotten, by a timer too if a shelf stays silent.
    """

    def __init__(self, days: int = WINDOW_DAYS):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bands = handle.getMapState("bands", "k long", "names string, at binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        span, mark = self.days * DAY_MS, timerValues.getCurrentWatermarkInMs()
        new = pd.concat(list(rows), ignore_index=True)
        new = new[new["at"] >= mark].sort_values(["k", "at", "content_hash"], kind="stable")
        if not len(new):
            return
        touched = np.unique(boxes(new["k"].to_numpy())).tolist() if self.bands.exists() else []
        stored = [v for v in (self.bands.getValue((box,)) for box in touched) if v is not None]
        old = Members.of(stored)
        old = old.take(old.at >= mark - span)
        all_ = pd.DataFrame({"k": np.append(old.k, new["k"]), "at": np.append(old.at, new["at"]), "node": np.append(old.names, new["content_hash"])})
        all_["fresh"] = np.arange(len(all_)) >= len(old)
        all_["signature"] = pd.Series([*[None] * len(old), *new["signature"]], dtype=object)
        # each name once in a band
        all_ = all_[~all_.duplicated(["k", "node"])]
        for box, value in Members(*(all_[c].to_numpy() for c in ("k", "at", "node"))).values():
            self.bands.updateValue((box,), value)
        self.handle.registerTimer(int(new["at"].max()) + span + 1)
        signed = all_[all_["signature"].notna()].assign(k=None)
        all_ = all_.sort_values(["k", "at"], kind="stable")
        met = all_[meeting(*(all_[c].to_numpy() for c in ("k", "at", "fresh")), span)].sort_values(["k", "node"], kind="stable").assign(signature=None)
        yield typed(signed)
        if len(met):
            made = (met["node"] + " " + met["at"].astype(str) + " " + met["fresh"].astype(str)).groupby(met["k"].to_numpy(), sort=False).agg("\n".join)
            yield typed(met.assign(k=met["k"].map({k: int.from_bytes(hashlib.blake2b(m.encode(), digest_size=8).digest(), "big", signed=True) for k, m in made.items()})))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        oldest = timerValues.getCurrentWatermarkInMs() - self.days * DAY_MS
        for (box,), value in list(self.bands.iterator()):
            held = Members.of([value])
            keep = held.at >= oldest
            if not keep.any():
                self.bands.removeKey((box,))
            elif not keep.all():
                self.bands.updateValue((box,), next(held.take(keep).values())[1])
        return iter(())

    def close(self) -> None:
        pass


def met(docs: DataFrame, late: str = "1 day", days: int = WINDOW_DAYS, threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """The stream of MET of a stream of docs (content_hash, text, created_at): signatures (k is null) and those that
    may be linked. Rows more than ``late`` behind the latest one are too late and take no part."""
    signs = signed(docs.select("content_hash", shingles(F.col("text"), digest=low_digest).alias("s"), "created_at")).filter("signature IS NOT NULL").withWatermark("created_at", late)
    keys = F.slice(band_keys(F.col("signature"), bands), 1, needed(threshold, bands))
    # a signature goes with the first of its bands only
    keyed = signs.select("created_at", "content_hash", F.unix_millis("created_at").alias("at"), "signature", F.posexplode(keys).alias("n", "k"))
    keyed = keyed.select("created_at", "content_hash", "at", F.when(F.col("n") == 0, F.col("signature")).alias("signature"), "k")
    return keyed.withColumn("shelf", F.pmod("k", F.lit(SHELVES))).groupBy("shelf").transformWithStateInPandas(Bands(days), MET, "append", "eventtime")


def link_stream(docs: DataFrame, store: str, checkpoint: str, late: str = "1 day", days: int = WINDOW_DAYS, threshold: float = THRESHOLD, bands: int = BANDS) -> None:
    """Write the links of all that a stream has by now below ``store``, one folder for each batch; running a batch again
    writes its folder again. A later call goes on from the checkpoint.

    Links (a, b) are between contents that agree and are at most ``days`` apart. They join what all such pairs would join,
    in any order of arrival and any split into batches; texts without tokens have none. Signatures are kept
    below ``store`` too, each once, and are read for those only that share a band with a new one.
    """
    spark, held = docs.sparkSession, f"{store}/_signatures"

    def put(batch: DataFrame, number: int) -> None:
        # "met" is False for signatures, which stay, and True for who may be linked
        batch.withColumn("met", F.col("k").isNotNull()).write.mode("overwrite").partitionBy("met").parquet(f"{held}/batch={number}")
        all_ = spark.read.schema(f"{MET}, batch long, met boolean").option("basePath", held).parquet(held)
        may = written(all_.filter(f"met AND batch = {number}").select("k", "node", "at", "fresh").distinct(), "met")
        least, most = may.agg(F.min("at"), F.max("at")).first()
        known = all_.filter("NOT met").filter(F.col("at").between(least, most)) if least is not None else all_.filter("false")
        known = known.join(may.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "signature")
        run_links(may.join(known, "node"), days * DAY_MS, threshold).write.mode("overwrite").parquet(f"{store}/batch={number}")
        delete(spark, f"{held}/batch={number}/met=true")

    with settings(spark, STORE):
        met(docs, late, days, threshold, bands).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def clusters(docs: DataFrame, store: str) -> DataFrame:
    """(content_hash, cluster_id) of docs (content_hash, created_at): the first 16 digits of the hash of the earliest
    document that the links below ``store`` join it with."""
    spark = docs.sparkSession
    found = spark.read.schema("a string, b string").parquet(store) if exists(spark, store) else spark.createDataFrame([], "a string, b string")
    roots = components(found.select("a", "b").distinct()).withColumnRenamed("node", "content_hash")
    first = docs.groupBy("content_hash").agg(F.min("created_at").alias("created_at"))
    named = first.join(roots, "content_hash", "left").withColumn("root", F.coalesce("root", "content_hash"))
    best = named.groupBy("root").agg(F.min_by("content_hash", F.struct("created_at", "content_hash")).alias("first"))
    return named.join(best, "root").select("content_hash", F.substring("first", 1, 16).alias("cluster_id"))
