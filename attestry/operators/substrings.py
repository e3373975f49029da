"""Which texts contain which needles, by an inverted index of q-grams.

A gram is a run of q characters at a place. Grams are sampled by their hash, so that a needle and every text that holds it
keep the same ones; long needles need few. Each needle asks for two of its rarest grams only, both must stand in a text
at the places that one position of the needle gives them, and texts are joined once, to compare the survivors in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Lengths of grams; a needle takes the longest that it has room for.
LENGTHS = (8, 4, 2, 1)
#: One in so many grams is kept for needles of at least so many characters.
SAMPLES = ((1600, 64), (200, 8), (0, 1))
#: Characters that a task has in hand at once, but for the rest of a text.
SLICE = 1 << 20
#: Bits of a filter of grams, at most, and those of one of its rows.
BITS, ROW = 1 << 26, 1 << 15


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash for each run of q of the code points."""
    h = np.full(max(len(points) - q + 1, 0), q, np.uint64)
    for j in range(q if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : len(h) + j]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _needle_grams(needles: DataFrame) -> DataFrame:
    """(id, key, n, gram, at, q, one_in) of the sampled grams of needles (id, key, n, text), at counts from 0; one that the
    sample leaves without grams keeps all of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, at, row, qs, levels = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                points = _points([text])
                q = next(x for x in LENGTHS if x <= len(points))
                one_in = next(k for least, k in SAMPLES if least <= len(points))
                h = gram_hashes(points, q)
                kept = np.flatnonzero(h % np.uint64(one_in) == 0)
                if not len(kept):
                    one_in, kept = 1, np.arange(len(h))
                for values, new in zip((grams, at, row, qs, levels), (h[kept].view(np.int64), kept, *(np.full(len(kept), x) for x in (i, q, one_in))), strict=True):
                    values.append(new)
                if sum(map(len, grams)) >= SLICE:
                    yield made(batch, grams, at, row, qs, levels)
                    grams, at, row, qs, levels = [], [], [], [], []
            if grams:
                yield made(batch, grams, at, row, qs, levels)

    def made(batch: pa.RecordBatch, grams: list, at: list, row: list, qs: list, levels: list) -> pa.RecordBatch:
        own = pa.array(np.concatenate(row))
        ints = [pa.array(np.concatenate(x).astype(np.int32)) for x in (at, qs, levels)]
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("id", "key", "n")), pa.array(np.concatenate(grams)), *ints], ["id", "key", "n", "gram", "at", "q", "one_in"])

    return needles.select("id", "key", "n", "text").mapInArrow(cut, f"{_typed(needles)}, gram long, at int, q int, one_in int")


def _typed(rows: DataFrame) -> str:
    return f"id {rows.schema['id'].dataType.simpleString()}, key {rows.schema['key'].dataType.simpleString()}, n int"


def _filters(asked: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """(q, one in, bits) that the grams of asked (gram, q, one_in) have set, two each; up to 8 MB, whatever is asked."""
    out = []
    for r in asked.groupBy("q", "one_in").agg(F.count("*").alias("n")).orderBy("q", "one_in").collect():
        size = min(BITS, max(ROW, 1 << (16 * r.n).bit_length()))
        own = asked.filter((F.col("q") == r.q) & (F.col("one_in") == r.one_in))
        bit = F.explode(F.array(*(F.shiftrightunsigned("gram", k).bitwiseAND(F.lit(size - 1)) for k in SHIFTS)))
        rows = own.select(bit.alias("bit")).groupBy(F.expr(f"bit div {ROW}").alias("row")).agg(F.bitmap_construct_agg(F.col("bit") % ROW).alias("bits"))
        bits = np.zeros((size // ROW, ROW // 8), np.uint8)
        for x in rows.toLocalIterator():
            bits[x.row] = np.frombuffer(bytes(x.bits), np.uint8)
        out.append((r.q, r.one_in, bits.reshape(-1)))
    return out


#: Where a gram's two bits begin.
SHIFTS = (8, 36)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes whose bits are set."""
    at = np.arange(len(h))
    for k in SHIFTS:
        bit = (h[at] >> np.uint64(k)) & np.uint64(len(bits) * 8 - 1)
        at = at[bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0]
    return at


def grams(texts: DataFrame, asked: DataFrame, places: bool) -> DataFrame:
    """(key, gram) of texts (id, key, n, text) for each place of a gram of asked, or (id, key, n, gram, at); a few others
    are among them. Texts are read where they are."""
    filters = texts.sparkSession.sparkContext.broadcast(_filters(asked))
    names = ["id", "key", "n", "gram", "at"] if places else ["key", "gram"]

    def found(batch: pa.RecordBatch, first: int, texts: list[str]) -> Iterator[pa.RecordBatch]:
        points, ends = _points(texts), np.cumsum([len(t) for t in texts])
        for q in sorted({x[0] for x in filters.value}):
            for low in range(0, len(points), SLICE):
                h = gram_hashes(points[low : low + SLICE + q - 1], q)
                hits = []
                for _, one_in, bits in (x for x in filters.value if x[0] == q):
                    own = np.flatnonzero(h % np.uint64(one_in) == 0) if one_in > 1 else np.arange(len(h))
                    hits.append(own[_has(bits, h[own])])
                at = np.unique(np.concatenate(hits))
                row = np.searchsorted(ends, at + low, "right")
                inside = at + low + q <= ends[row]
                at, row = at[inside], row[inside]
                own, gram = pa.array(row + first), pa.array(h[at].view(np.int64))
                start = at + low - (ends[row] - np.array([len(t) for t in texts])[row]) if len(row) else at
                values = [*(batch.column(c).take(own) for c in names if c in ("id", "key", "n")), gram, *([pa.array(start.astype(np.int32))] if places else [])]
                yield pa.RecordBatch.from_arrays(values, names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size = 0, [], 0
            for i, text in enumerate(batch.column("text").to_pylist()):
                held.append(text)
                size += len(text)
                if size >= SLICE:
                    yield from found(batch, first, held)
                    first, held, size = i + 1, [], 0
            if size:
                yield from found(batch, first, held)

    kinds = f"{_typed(texts)}, gram long, at int" if places else f"{_typed(texts).split(', ')[1]}, gram long"
    return texts.select("id", "key", "n", "text").mapInArrow(scan, kinds)


def occurrences(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle_id, text_id) of the needles (id, key, text) that stand in texts (id, key, text) of the same key, each once.

    Ids are distinct within a side; a null key or text meets nothing, as an empty needle does (it stands in every text of
    its key, which needs no search). Exact: sampled grams of a needle are sampled in each text that holds it, and what two
    grams agree on is compared in full, by the MD5 of the piece of the text. Every step moves ids, places and hashes;
    texts move once, to their candidates. A gram that many texts hold is asked for only by needles that have no rarer one. Texts
    are read twice for grams: to count those of the needles, then for the places of those that are asked for; bit filters
    of bounded size leave out the others before anything moves.
    """
    sized = lambda df: df.filter("key IS NOT NULL AND text IS NOT NULL").select("id", "key", F.length("text").alias("n"), "text")
    needles, texts = sized(needles).filter("n > 0"), sized(texts)
    asked = written(_needle_grams(needles), "needle-grams")
    # counted where they are, then put together
    counts = grams(texts, asked, False).groupBy("key", "gram").agg(F.count("*").alias("_texts"))
    found = asked.join(counts, ["key", "gram"], "left")
    best = F.struct(F.coalesce("_texts", F.lit(0)).alias("c"), "gram", "at", "q", "one_in")
    # the rarest gram of either half of all grams
    half = lambda r: F.min(F.when(F.pmod(F.shiftright("gram", 7), F.lit(2)) == r, best))
    chosen = found.groupBy("id", "key", "n").agg(half(0).alias("_a"), half(1).alias("_b"))
    chosen = chosen.withColumn("_both", F.filter(F.array("_a", "_b"), lambda g: g.isNotNull())).filter(F.forall("_both", lambda g: g["c"] > 0))
    chosen = chosen.select(F.col("id").alias("needle_id"), "key", F.col("n").alias("_n"), F.size("_both").alias("_grams"), F.explode("_both").alias("_g"))
    chosen = written(chosen.select("needle_id", "key", "_n", "_grams", "_g.gram", F.col("_g.at").alias("_offset"), "_g.q", "_g.one_in"), "chosen")
    # only grams that some needle asks for have their places listed
    index, chosen = grams(texts, chosen, True), chosen.drop("q", "one_in")
    met = index.join(chosen, ["key", "gram"]).withColumn("_from", F.col("at") - F.col("_offset")).filter("_from >= 0 AND _from + _n <= n")
    agreed = met.groupBy("needle_id", F.col("id").alias("text_id"), "_from", "_n", "_grams").agg(F.count("*").alias("_met")).filter("_met = _grams")
    digests = needles.select(F.col("id").alias("needle_id"), F.md5("text").alias("_digest"))
    agreed = written(agreed.drop("_met", "_grams").join(digests, "needle_id"), "candidates")
    piece = F.md5(F.substring(F.col("text"), F.col("_from") + 1, F.col("_n")))
    return agreed.join(texts.select(F.col("id").alias("text_id"), "text"), "text_id").filter(piece == F.col("_digest")).select("needle_id", "text_id").distinct()
