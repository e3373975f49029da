"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

A text is cut into windows of some dozen bytes at spaces. Of each view's two dictionaries both hold the same
passages of ordinary text; after them come segments of the dictionary's own kind of text. A window's distance is its compressed length under the ordinary dictionary less that under the toxic
one. Segments are chosen as zstandard's cover trainer does it, greedily by the grams they add, but a gram counts by
how much more often toxic documents hold it than ordinary ones. Of a document count how many of its windows pass
each threshold of the distance; a logistic regression calibrates these counts to a score. Its training counts come
from dictionaries made without the counted document's third of the sample.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .common import small_batches


class View(NamedTuple):
    """Bytes of a window, the least match that counts, bytes of ordinary passages that both dictionaries hold, bytes
    in which they differ, bytes of a segment and of the grams that choose it."""

    window: int
    match: int
    shared: int
    own: int
    segment: int
    gram: int


#: Labelled rows that the classifier is fitted on, at most, and bytes read of them, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 16_000, 64_000_000
#: Longer matches tell words apart, shorter ones parts of compounds.
VIEWS = (View(56, 6, 100_000, 4_000, 20, 8), View(40, 4, 60_000, 2_500, 12, 6))
#: Bytes by which a window must be shorter under the toxic dictionary to be counted.
THRESHOLDS = (1, 2, 3, 4, 5, 6, 8, 10, 14)
#: Bytes of an ordinary passage.
PASSAGE = 128
#: Places for counts of grams, as a power of two; documents that a gram must be in; how much likelier it must be in one kind.
PLACES, LEAST, ODDS = 22, 3, 4.0
#: Grams that choose segments, at most: the most telling ones.
TELLING = 20_000
#: Parts of the sample for calibration.
FOLDS = 3


def windows(text: str | None, size: int) -> list[bytes]:
    """Successive windows of a text in lower case, of ``size`` bytes or fewer, cut before a space if they hold one; at least one."""
    b, out, i = (text or "").lower().encode(), [], 0
    while i < len(b):
        j = i + size
        if j < len(b) and (k := b.rfind(b" ", i + 1, j)) > 0:
            j = k
        out.append(b[i:j])
        i = j
    return out or [b""]


@dataclass
class Model:
    """What is sent to the tasks: views with their ordinary and toxic dictionaries (under 0.4 MB) and the fitted weights."""

    dictionaries: list[tuple[View, bytes, bytes]]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A task's compressors."""

    def __init__(self, model: Model):
        import zstandard as zs

        def compressor(dictionary: bytes, match: int):
            how = zs.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=3, min_match=match, target_length=64, strategy=zs.STRATEGY_BTLAZY2, write_content_size=False, write_dict_id=False, write_checksum=False)
            return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how).compress

        self.model = model
        self.views = [(v.window, compressor(ordinary, v.match), compressor(toxic, v.match)) for v, ordinary, toxic in model.dictionaries]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text. One dictionary after the other, so that its tables stay in the processor's cache."""
        out = [np.zeros((len(texts), 0))]
        for size, ordinary, toxic in self.views:
            parts = [windows(t, size) for t in texts]
            n = np.array([len(p) for p in parts])
            d = np.fromiter((len(ordinary(w)) for p in parts for w in p), np.float64, n.sum())
            d -= np.fromiter((len(toxic(w)) for p in parts for w in p), np.float64, n.sum())
            first = np.cumsum(n) - n
            over = np.stack([np.add.reduceat(d >= k, first, dtype=np.float64) for k in THRESHOLDS], 1)
            last = np.sort(np.repeat(np.arange(len(n)), n) * 1e6 + d) - np.repeat(np.arange(len(n)), n) * 1e6
            at = np.repeat(first + n, n) - np.arange(len(d)) <= 3
            top = np.add.reduceat(np.where(at, last, 0), first) / np.minimum(n, 3)
            out += [np.log1p(n)[:, None], np.log1p(over), over / n[:, None], np.stack([np.maximum.reduceat(d, first), np.add.reduceat(d, first) / n, top], 1)]
        return np.hstack(out)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        m = self.model
        return 1 / (1 + np.exp(-np.clip(m.weights[0] + ((self.features(texts) - m.mean) / m.scale) @ m.weights[1:], -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _grams(b: bytes, n: int) -> np.ndarray:
    """The place of the gram of n bytes (8 at most) at each position."""
    x = np.frombuffer(b, np.uint8).astype(np.uint64)
    if len(x) < n:
        return np.zeros(0, np.int64)
    h = np.zeros(len(x) - n + 1, np.uint64)
    for i in range(n):
        h = h << np.uint64(8) | x[i : len(x) - n + 1 + i]
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACES)).astype(np.int64)


def _ordinary(texts: list[bytes], size: int, seed: int) -> bytes:
    """Passages from random places of random texts, ``size`` bytes in all (fewer only without any text)."""
    r, out, n = np.random.default_rng(seed), [], 0
    whole = [t for t in texts if t]
    while whole and n < size:
        t = whole[int(r.integers(len(whole)))]
        at = int(r.integers(max(len(t) - PASSAGE, 0) + 1))
        out.append(t[at : at + PASSAGE])
        n += len(out[-1])
    return b"".join(out)[:size]


def _held(texts: list[tuple[bytes, int]], gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many ordinary and toxic texts hold each gram, how many there are)."""
    held, total = np.zeros((2, 1 << PLACES), np.uint16), np.zeros(2)
    for t, y in texts:
        held[y, np.unique(_grams(t, gram))] += 1
        total[y] += 1
    return held, total


def _segments(texts: list[bytes], view: View, held: np.ndarray, total: np.ndarray) -> bytes:
    """Segments of texts of one kind that cover the grams which these hold more often than others do, the most telling
    last. held: how many texts of this and of the other kind hold each gram; total: how many there are."""
    worth = np.zeros(1 << PLACES, np.float32)
    for i in range(0, len(worth), 1 << 18):  # some places at a time, for the driver's memory
        at = i + np.nonzero(held[0, i : i + (1 << 18)] >= LEAST)[0]
        odds = np.log((held[0, at] + 0.5) / (total[0] + 1)) - np.log((held[1, at] + 0.5) / (total[1] + 1))
        worth[at] = np.where(odds > np.log(ODDS), held[0, at] * odds, 0)
    telling = worth[worth > 0]
    if len(telling) > TELLING:
        worth[worth < np.partition(telling, -TELLING)[-TELLING]] = 0
    best: dict[int, tuple[float, bytes]] = {}
    for t in texts:
        g = _grams(t, view.gram)
        w = worth[g]
        for i in (np.unique(np.nonzero(w)[0] // view.segment) * view.segment).tolist():
            top = i + int(w[i : i + view.segment].argmax())
            a = max(0, top - 4)
            found = float(w[a : a + view.segment - view.gram + 1].sum()), t[a : a + view.segment]
            best[int(g[top])] = max(best.get(int(g[top]), found), found)
    value = lambda s: float(worth[_grams(s, view.gram)].sum())
    heap, out, size = [(-value(s), s) for s in {s for _, s in best.values()}], [], 0
    heapq.heapify(heap)
    while heap and size < view.own:
        s = heapq.heappop(heap)[1]
        now = value(s)  # less than it was once another segment covers its grams
        if now <= 0:
            continue
        if heap and now < -heap[0][0]:
            heapq.heappush(heap, (-now, s))
            continue
        out.append(s)
        size += len(s)
        worth[_grams(s, view.gram)] = 0
    return b"".join(reversed(out))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (intercept first) of a ridge logistic regression, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    b, keep = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        b += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ b)
    return mean, scale, b


def _models(parts: list[list[tuple[bytes, int]]]) -> list[Model]:
    """Dictionaries of all texts, and of all but each part (texts in lower case). Grams are counted once."""
    chosen = [[t for j, part in enumerate(parts) if j != k for t in part] for k in (-1, *range(len(parts)))]
    models = [Model([]) for _ in chosen]
    for i, view in enumerate(VIEWS):
        counts = [_held(part, view.gram) for part in parts]
        held, total = sum(c[0] for c in counts), sum(c[1] for c in counts)
        for k, (texts, model) in enumerate(zip(chosen, models, strict=True)):
            n = total - counts[k - 1][1] if k else total
            if k:
                held -= counts[k - 1][0]
            ordinary = [t for t, y in texts if not y]
            ends = [_segments([t for t, y in texts if y], view, held[::-1], n[::-1]), _segments(ordinary, view, held, n)]
            shared, longer = _ordinary(ordinary, view.shared, 2 * i), max(map(len, ends))
            toxic, own = (shared + _ordinary(ordinary, longer - len(e), 2 * i + 1) + e for e in ends)
            model.dictionaries.append((view, own, toxic))
            if k:
                held += counts[k - 1][0]
    return models


def _constant(toxic: float, n: int) -> Model:
    """What gives every text the smoothed share of toxic ones."""
    share = (toxic + 0.5) / (n + 1.5)
    return Model([], np.zeros(0), np.ones(0), np.array([np.log(share / (1 - share))]))


def fit(texts: list[tuple[str, int, int]]) -> Model:
    """Make the dictionaries and calibrate them. texts: (text, label, part below FOLDS) in a settled order.

    Each text's features are by the model (of those made without a part) that has not seen it.
    With labels of one kind only, or none, every text scores the smoothed share of toxic ones (a third without labels).
    """
    y = np.array([label for _, label, _ in texts], dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return _constant(y.sum(), len(y))
    model, *others = _models([[(t.lower().encode(), y) for t, y, part in texts if part == k] for k in range(FOLDS)])
    scorers = [m.scorer() for m in others]
    model.mean, model.scale, model.weights = _logistic(np.array([scorers[part].features([t])[0] for t, _, part in texts]), y)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``rows`` labelled documents and ``size`` bytes of text, least hash of doc_id first.

    labels: doc_id, toxic. Rows with a null id or label are left out; of repeated ids one row counts, the least text
    with the greater label. Equal hashes go by doc_id. Whole texts are read, null ones as empty; a text that goes
    beyond ``size`` ends the sample. Dictionaries are made by one task, the calibration's features by many; neither the sample nor
    its counts reach the driver.
    """
    labels = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("d"), (F.col("toxic") > 0).cast("int").alias("y"))
    chosen = labels.groupBy("d").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("d").cast("string")), "d").limit(rows)
    picked = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("d"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "d")
    picked = picked.groupBy("d").agg(F.min("text").alias("text"), F.max("y").alias("y")).withColumns({"h": F.md5(F.col("d").cast("string")), "part": F.pmod(F.xxhash64("d"), F.lit(FOLDS)).cast("int")})
    spark, sample = docs.sparkSession, written(picked, "labelled")
    small_batches(spark, 100)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, out = size, []
        for text, y, part in (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "part")), strict=True)):
            if (left := left - len(text.encode())) < 0:
                break
            out.append((text.lower().encode(), y, part))
        several = 0 < sum(y for _, y, _ in out) < len(out)
        models = _models([[(t, y) for t, y, part in out if part == k] for k in range(FOLDS)]) if several else []
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(out)], pa.int64()), "toxic": pa.array([sum(y for _, y, _ in out)], pa.int64()), "models": pa.array([pickle.dumps(models)], pa.binary())})

    # one task for the bounded sample; the driver has the dictionaries only
    in_order = sample.select("h", "d", "text", "y", "part").repartition(1).sortWithinPartitions("h", "d")
    made = in_order.mapInArrow(make, "n long, toxic long, models binary").first()
    n, toxic = (made.n, made.toxic) if made else (0, 0)
    if not 0 < toxic < n:
        return _constant(toxic, n)
    model, *others = pickle.loads(made.models)
    sent = spark.sparkContext.broadcast(others)

    @F.pandas_udf("array<double>")
    def features(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorers = [m.scorer() for m in sent.value]
        for text, part in texts:
            x = np.zeros((len(text), 0))
            for p in sorted(set(part)):
                found = scorers[p].features(text[part == p].tolist())
                x = x if x.shape[1] else np.zeros((len(text), found.shape[1]))
                x[(part == p).to_numpy()] = found
            yield pd.Series(list(x))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(sample.repartition(parts, "d").select("h", "d", "y", features("text", "part").alias("x")), "features")
    rows = [(np.array(r.x), r.y) for r in found.orderBy("h", "d").limit(n).toLocalIterator()]
    model.mean, model.scale, model.weights = _logistic(np.array([x for x, _ in rows]), np.array([y for _, y in rows], dtype=np.float64))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add toxicity (0 to 1) to docs (text and any other columns), in place of any column of that name. Null and empty texts are scored too;
    whole texts are read. Empty input: no rows."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxicity(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = sent.value.scorer()
        for batch in texts:
            yield pd.Series(scorer.scores(batch.tolist()), dtype="float64")

    return docs.withColumn("toxicity", toxicity(F.col("text")))


def held_out(doc_id: str) -> Column:
    """Whether a row is kept from training: CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
