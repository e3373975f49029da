"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .common import row_key, small_batches

#: Words that are units where they follow a number; fixed list.
UNITS = frozenset("mm cm m km in ft yd mi mile miles inch inches foot feet yard yards g kg mg lb lbs oz ton tons gram grams kilogram kilograms l ml liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars cent cents euro euros pound pounds percent degree degrees mph kmh hz khz mhz ghz w kw v a j n pa kb mb gb tb k".split())
#: Words for numbers; fixed list. Words that are articles or ordinals as well are left out.
NUMBERS = frozenset("zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze vingt trente cent mille dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cien mil".split())
#: Words that are no names where they open a sentence; fixed list.
OPENERS = frozenset("a an the this that these those it its he she they we you his her their our my your there here in on at to of for from by with as if when while after before because since until how what which who whom whose where why is are was were do does did has have had can could will would should may might must and but or so then each every all some any no not let find given calculate compute suppose assume consider der die das ein eine einer es er sie wir ihr wie was wer wo wann warum wenn und aber oder in im am auf mit von zu nach bei aus für ist sind war hat haben kann nicht le la les un une des du de il elle ils nous vous on ce cette et mais ou si quand comment que qui combien pourquoi où dans sur avec pour par est sont a ont el los las una unos y pero o cuando como cuánto cuántos quién qué dónde por para con en es son ha tiene".split())
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*(?:(?:st|nd|rd|th)(?![^\W_]))?")
PLACEHOLDERS = {"number": "\0number", "unit": "\0unit", "name": "\0name"}
#: Words of a window, plain words that a template window needs, and the part of an item's windows that is a leak.
WINDOW, PLAIN, LEAK = 5, 2, 0.8
#: Fewer words than TEMPLATE_WORDS are compared as they are only; fewer than SHORTEST only with whole documents.
TEMPLATE_WORDS, SHORTEST = 8, 3
#: Sent to every task, at most: hashes of benchmark windows (8 bytes each), bytes of their rows, candidate pairs (32 bytes each).
#: Beyond these, all is joined.
BROADCAST_WINDOWS, BROADCAST_BYTES, BROADCAST_PAIRS = 2_000_000, 64_000_000, 500_000
#: Tokens that a worker remembers before it starts anew.
MEMO = 500_000
P = np.uint64(0x9E3779B97F4A7C15)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode(), 5)


class Templates:
    """Turns texts into window hashes, of the words as they are and of their template."""

    def __init__(self, window: int = WINDOW, plain: int = PLAIN):
        self.window, self.plain = window, plain
        self.number, self.unit, self.name = (np.uint64(_hash(PLACEHOLDERS[k])) for k in ("number", "unit", "name"))
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        # hash, and what a token may be: 1 number, 2 unit, 4 name
        self.hash, self.kind = np.zeros(1024, np.uint64), np.zeros(1024, np.uint8)

    def _learn(self, token: str) -> int:
        i = self.ids[token] = len(self.ids)
        if i == len(self.hash):
            self.hash, self.kind = np.resize(self.hash, 2 * i), np.resize(self.kind, 2 * i)
        low = token.lower()
        self.hash[i] = _hash(low)
        number = token[0].isdigit() or low in NUMBERS
        name = not number and len(token) > 1 and token[0].isupper() and not token.isupper() and low not in OPENERS
        self.kind[i] = number + 2 * (low in UNITS) + 4 * name
        return i

    def tokens(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(words, hashes as they are, hashes of the template, which are slots)."""
        if len(self.ids) > MEMO:
            self._forget()
        words, known, learn = TOKEN.findall(text or ""), self.ids, self._learn
        ids = np.array([i if (i := known.get(w)) is not None else learn(w) for w in words], dtype=np.int64)
        kind, plain = self.kind[ids], self.hash[ids]
        number = kind & 1 > 0
        unit = (kind & 2 > 0) & ~number
        unit[1:] &= number[:-1]
        unit[:1] = False
        name = (kind & 4 > 0) & ~unit
        template = np.where(number, self.number, np.where(unit, self.unit, np.where(name, self.name, plain)))
        return words, plain, template, number | unit | name

    def _rolled(self, h: np.ndarray, window: int) -> np.ndarray:
        n = len(h) - window + 1
        out = np.full(n, window, np.uint64)
        for j in range(window):
            out = out * P + h[j : j + n]
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def windows(self, text: str | None, short: tuple[int, ...] | None = None) -> tuple[list[str], list[tuple[int, int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """(words, [(form, words of a window, hashes, valid)], slots, windows that templates can match).

        Form 0 are the words as they are, 1 the template, 2 short windows as they are: of an item its whole
        (``short`` is None), of a document those of the lengths ``short``; 3 is the whole of the shortest texts.
        """
        words, plain, template, slot = self.tokens(text)
        n, w = len(words), self.window
        if not n:
            return words, [], slot, np.zeros(0, bool)
        if n < SHORTEST:
            return words, [(3, n, self._rolled(plain, n), np.ones(1, bool))], slot, np.ones(1, bool)
        lengths = [k for k in short if k <= n] if short is not None else [n] if n < w else []
        out = [(2, k, self._rolled(plain, k), np.ones(n - k + 1, bool)) for k in lengths]
        judged = np.ones(1, bool)
        if n >= w:
            sums = np.concatenate([[0], np.cumsum(slot)])
            inside = sums[w:] - sums[:-w]
            judged = inside <= w - self.plain
            out.append((0, w, self._rolled(plain, w), np.ones(len(inside), bool)))
            if slot.any() and (short is not None or n >= TEMPLATE_WORDS):
                out.append((1, w, self._rolled(template, w), judged & (inside > 0)))
            if not judged.any() or n < TEMPLATE_WORDS:
                judged = np.ones(len(inside), bool)
        return words, out, slot, judged


HITS = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("form", pa.int32()), ("pos", pa.int32()), ("slots", pa.list_(pa.string())), ("judged", pa.bool_())])
HIT_SPEC = "key binary, doc_id long, hash long, form int, pos int, slots array<string>, judged boolean"


def _emit(rows: Iterator[tuple], window: int, short: tuple[int, ...] | None, known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows of (key, id, text) rows, those whose hash is known only. Without ``short`` the rows are items."""
    t = Templates(window)
    seen = None
    if known is not None:
        seen = np.zeros(1 << 22, bool)
        seen[(known >> np.uint64(42)).astype(np.int64)] = True
    out: list[dict] = []
    for key, i, text in rows:
        words, forms, slot, judged = t.windows(text, short)
        for form, size, h, valid in forms:
            at = np.nonzero(valid if seen is None else valid & seen[(h >> np.uint64(42)).astype(np.int64)])[0]
            if known is not None and len(at):
                at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]
            for a in at.tolist():
                out.append({"key": key, "doc_id": i, "hash": int(h[a].view(np.int64)), "form": form, "pos": a, "slots": [words[j].lower() for j in range(a, a + size) if slot[j]] if form == 1 else [], "judged": bool(judged[a]) if short is None else None})
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema=HITS)
                out = []
    yield pa.RecordBatch.from_pylist(out, schema=HITS)


def consistent(hits: list[dict]) -> tuple[set[int], int]:
    """(item positions whose windows hold, slots that changed) of hits on one alignment of an item.

    An item's slot value must stand for one value throughout; the one it stands for most often counts,
    and windows with any other don't.
    """
    seen: dict[str, dict[str, int]] = {}
    for h in hits:
        for a, b in zip(h["item_slots"], h["slots"], strict=True):
            seen.setdefault(a, {})[b] = seen.setdefault(a, {}).get(b, 0) + 1
    means = {a: max(sorted(v), key=v.get) for a, v in seen.items()}
    good = {h["item_pos"] for h in hits if all(means[a] == b for a, b in zip(h["item_slots"], h["slots"], strict=True))}
    return good, sum(a != b for a, b in means.items())


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = LEAK) -> DataFrame:
    """Which rows of docs (doc_id, text) hold which items of benchmark (item_id, text).

    Numbers (digits or words), units after a number and capitalised words (but for common openers of a
    sentence) become typed placeholders, wherever they stand. Windows of ``window`` words, as they are and as
    templates (with at least PLAIN plain words), are joined by hash; template windows of one alignment count
    only where each of the item's slot values stands for one value of the document, so a question with other
    numbers or names is found and chance meetings of templates are not. A leak holds ``share`` or more of the
    item's windows that a template can match (of all, if there are none or the item has fewer than
    TEMPLATE_WORDS words, which are compared as they are only).

    Items of SHORTEST to ``window`` - 1 words are windows of their own length; shorter ones match documents
    of just these words. Items and documents without words match nothing; null text is empty. Repeated items
    are items of their own, rows with equal doc_id and text are one, a null id is one as well. Empty tables:
    no rows. Whole texts are read; hashes the benchmark does not have are dropped where they arise if the
    benchmark has BROADCAST_WINDOWS windows or fewer, else by the join itself. A pair that holds ``share`` of
    an item's windows has one of its rarest 1 - ``share``, so only pairs that meet in one of these are counted.

    Returns key (see row_key), doc_id, item_id, matched, windows, share, changed_slots.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def of(known, short):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = known.value if known is not None else None
            for batch in batches:
                yield from _emit(zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True), window, short, sent)

        return emit

    items = benchmark.filter("text IS NOT NULL").select(F.unhex(F.md5(F.concat_ws("|", F.monotonically_increasing_id().cast("string"), "text"))).alias("key"), F.col("item_id").cast("long").alias("doc_id"), "text")
    bench = written(items.mapInArrow(of(None, None), HIT_SPEC), "benchmark").withColumnsRenamed({"key": "item", "doc_id": "item_id", "pos": "item_pos", "slots": "item_slots"})
    known, n, size = None, *bench.agg(F.count("*"), F.sum(F.length(F.array_join("item_slots", "  ")) + 80)).first()
    if n <= BROADCAST_WINDOWS:
        found = np.unique(np.array([r.hash for r in bench.select("hash").distinct().toLocalIterator()], dtype=np.int64).view(np.uint64))
        known = spark.sparkContext.broadcast(found if len(found) else np.zeros(1, np.uint64))
    sent = F.broadcast if (size or 0) <= BROADCAST_BYTES else (lambda df: df)
    # words of short items, of which there are few lengths
    short = tuple(sorted(r.n for r in items.join(sent(bench.filter("form = 2").select(F.col("item").alias("key"))), "key", "left_semi").mapInArrow(_lengths, "n int").distinct().collect()))
    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = written(rows.mapInArrow(of(known, short), HIT_SPEC).drop("judged"), "hits")
    hits = hits.join(sent(bench.select("hash", "form").distinct()), ["hash", "form"], "left_semi").distinct()
    # the rarest windows of each item, by the documents' windows that meet them in either form
    often = hits.groupBy("hash", "form").agg(F.count("*").alias("n"))
    places = bench.filter("judged").join(often, ["hash", "form"], "left").groupBy("item", "item_pos").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    ranked = places.withColumns({"windows": F.count("*").over(Window.partitionBy("item")), "rank": F.row_number().over(Window.partitionBy("item").orderBy("n", "item_pos"))})
    ranked = written(ranked.drop("n"), "places")
    probes = ranked.filter(F.col("rank") <= F.col("windows") - F.ceil(F.col("windows") * share - 1e-9) + 1).select("item", "item_pos").join(bench, ["item", "item_pos"])
    pairs = written(hits.select("key", "hash", "form").join(sent(probes.select("item", "hash", "form").distinct()), ["hash", "form"]).select("key", "item").distinct(), "pairs")
    mine = hits.join(F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs, "key")
    met = mine.join(sent(bench.filter("judged")), ["item", "hash", "form"])
    # within one alignment an item's position occurs once in each form, so a list is as long as the item at most
    aligned = met.groupBy("key", "doc_id", "item", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_list(F.struct("item_pos", "item_slots", "slots")).alias("met"))
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("item", pa.binary()), ("item_id", pa.int64()), ("changed", pa.int32()), ("good", pa.list_(pa.int32()))])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                good, changed = consistent(r["met"])
                out.append({k: r[k] for k in ("key", "doc_id", "item", "item_id")} | {"changed": changed, "good": sorted(good)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    checked = aligned.mapInArrow(check, "key binary, doc_id long, item binary, item_id long, changed int, good array<int>")
    per = checked.groupBy("key", "doc_id", "item", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("good")))).alias("matched"), F.max("changed").alias("changed_slots"))
    per = per.join(sent(ranked.select("item", "windows").distinct()), "item").withColumn("share", F.col("matched") / F.col("windows"))
    return per.filter(F.col("share") >= share).select("key", "doc_id", "item_id", "matched", "windows", "share", "changed_slots")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(TOKEN.findall(t)) for t in batch.column("text").to_pylist()], pa.int32())], names=["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = LEAK) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, unchanged; see leaks. Rows without an id or a text stay
    unless their text holds one, repeated rows go or stay together. Empty tables: all rows stay."""
    held = written(leaks(docs, benchmark, window, share).select(F.col("key").alias("_key")).distinct(), "leaks")
    small = held.count() <= BROADCAST_WINDOWS // 4
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("_own"))
    return rows.join(F.broadcast(held) if small else held, F.col("_own") == F.col("_key"), "left_anti").select("row.*")
