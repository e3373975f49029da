"""Repeated passages across documents, by column-wise construction of a collection's suffix order.

Removed is each byte covered by a string of ``least`` bytes that also starts in a document with a smaller
id. The construction inserts one symbol of every string per round, last symbols first, into the
Burrows-Wheeler transform of the collection, and keeps the common prefixes of neighbours up to date; both
are rewritten in one sequential pass per round. As many rounds are needed as the longest string has
symbols and each passes over all that is there, so whole documents are not inserted. Instead:

1. Documents are written as blocks (row groups of Parquet files in the shared folder), which tasks read.
2. A string of ``least`` bytes chooses the gram of GRAM bytes in it with the least hash, its anchor. Equal
   strings choose equal anchors, so only anchors that occur in two documents matter. Blocks send their
   distinct anchor hashes to buckets; the buckets answer with a bit for each.
3. Blocks send the distinct contexts of shared anchors (the bytes of all strings that chose the anchor,
   under 2 * least bytes) with the smallest id that has them. A bucket builds the suffix order of the
   contexts of an anchor, column by column; suffixes whose common prefixes have ``least`` bytes form a run,
   whose smallest id decides. It answers with a bit for each string of each context.
4. Blocks mark and remove bytes.

All rows between blocks and buckets are sums over a block, so a passage in a third of all documents comes
once from each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import work_path, written
from .common import small_batches
from .files import opened

LEAST, GRAM = 50, 24
#: Bytes of a row group (before compression, about), of text hashed at once, of text a bucket stands for, and
#: symbols inserted at once.
BLOCK_BYTES, PIECE_BYTES, BUCKET_BYTES, SYMBOLS = 4 << 20, 1 << 16, 8 << 20, 300_000
END = 255  # no byte of UTF-8
LAST = (1 << 63) - 1
_r = np.random.default_rng(24)
TABLE = _r.integers(0, 2**64, 256, dtype=np.uint64)
P = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(6)]


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at each position, from hashes of 1, 2, 4, ... bytes."""
    h, size, out, done = TABLE[b], 1, None, 0
    level = 0
    while True:
        if gram & size:
            part = h[done : len(b) - gram + done + 1]
            out = part.copy() if out is None else out[: len(part)] * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + part
            done += size
        size *= 2
        if size > gram:
            break
        h = h[: len(h) - size // 2] * P[level] + h[size // 2 :]
        level += 1
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def anchors(text: np.ndarray, lengths: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of each anchor of joined documents: the strings of ``least`` bytes that start at
    first..last chose it. Strings do not cross documents. Of equal grams in a string the leftmost is chosen."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(text) < least:
        return none
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    start = np.nonzero(doc[: len(text) - least + 1] == doc[least - 1 :])[0]
    if not len(start):
        return none
    h = _gram_hashes(text, gram)
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, done = least - gram + 1, 1
    while done < width:
        step = min(done, width - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    at = (m[start] & low).astype(np.int64)
    new = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
    chosen = h[at[new]]  # least hashes, so mixed anew for an even choice of buckets
    chosen ^= chosen << np.uint64(21)
    chosen *= np.uint64(0x94D049BB133111EB)
    chosen ^= chosen >> np.uint64(32)
    return chosen, start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]


class Block:
    """A row group's documents and their anchors."""

    def __init__(self, store, path: str, name: str, least: int, gram: int):
        file, _, group = name.rpartition("#")
        with store.open_input_file(f"{path}/{file}") as f:
            t = pq.ParquetFile(f).read_row_group(int(group), columns=["d", "text"])
        self.ids = t.column("d").to_numpy()
        texts = [x.encode() for x in t.column("text").to_pylist()]
        self.lengths = np.array([len(x) for x in texts], dtype=np.int64)
        self.text = b"".join(texts)
        del texts, t
        whole, found, ends = np.frombuffer(self.text, np.uint8), [], np.cumsum(self.lengths)
        i = at = 0
        while i < len(self.lengths):  # a piece is some documents, or one long one
            j = max(i + 1, int(np.searchsorted(ends, at + PIECE_BYTES)))
            found += [(h, a + at, b + at) for h, a, b in _pieces(whole[at : ends[j - 1]], self.lengths[i:j], least, gram)]
            i, at = j, int(ends[j - 1])
        self.hash, self.first, self.last = (np.concatenate(x) for x in zip(*found, strict=True)) if found else anchors(whole[:0], self.lengths[:0])
        self.doc = np.searchsorted(ends, self.first, side="right")
        self.distinct, self.of = np.unique(self.hash, return_inverse=True)

    def contexts(self, shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """(occurrences of shared anchors, context of each, contexts, their hashes, their smallest ids)."""
        at = np.nonzero(shared[self.of])[0]
        seen: dict[bytes, int] = {}
        text, of = self.text, np.empty(len(at), np.int64)
        for n, (a, b) in enumerate(zip(self.first[at].tolist(), (self.last[at] + least).tolist(), strict=True)):
            of[n] = seen.setdefault(text[a:b], len(seen))
        hashes, least_id = np.zeros(len(seen), np.uint64), np.full(len(seen), LAST, np.int64)
        hashes[of] = self.hash[at]
        np.minimum.at(least_id, of, self.ids[self.doc[at]])
        return at, of, list(seen), hashes, least_id


def _pieces(text: np.ndarray, lengths: np.ndarray, least: int, gram: int) -> Iterator[tuple]:
    """Anchors of a piece; one of over 8 MB is a single long document, cut where anchors do not depend on the cut."""
    most = 8 << 20
    if len(text) <= most:
        yield anchors(text, lengths, least, gram)
        return
    for at in range(0, len(text) - least + 1, most):
        part = text[at : at + most + least - 1]
        h, a, b = anchors(part, np.array([len(part)]), least, gram)
        yield h, a + at, b + at


def _least_between(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The least of values[start:stop] for each of some ranges, none empty. In order of start, so that what
    lies between two ranges is short."""
    out = np.empty(len(start), values.dtype)
    if len(start):
        order = np.argsort(start, kind="stable")
        out[order] = np.minimum.reduceat(values, np.stack([start[order], stop[order]], 1).ravel())[::2]
    return out


def suffix_order(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, common prefix with the one before) of all suffixes of the strings that data joins.

    Round r inserts the suffix of r symbols of each string that has so many. Its place follows from the
    place of the suffix one shorter and the transform so far (one stable sort of it by symbol). Suffixes
    that end sort first, in order of their strings; an end has no prefix in common with another.
    """
    m = len(lengths)
    text, ends = np.frombuffer(data, np.uint8), np.cumsum(lengths)
    bwt = np.full(m, END, np.uint8)
    bwt[lengths > 0] = text[ends[lengths > 0] - 1]
    lcp, who, off = np.zeros(m, np.uint8), np.arange(m, dtype=np.int32), lengths.astype(np.int16)
    live = np.nonzero(lengths > 0)[0]
    pos, r = live.copy(), 0
    while len(live):
        r += 1
        n = len(bwt)
        order = np.argsort(bwt, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        f = place[pos]
        new = m + f
        # common prefixes with the neighbours: one more than the least between their shorter suffixes
        padded = np.concatenate([lcp, [np.uint8(0)]])
        before, after = order[np.maximum(f - 1, 0)], order[np.minimum(f + 1, n - 1)]
        same = (f > 0) & (bwt[before] == bwt[pos])
        follows = (f + 1 < n) & (bwt[after] == bwt[pos])
        up, down = np.zeros(len(pos), np.uint8), np.zeros(len(pos), np.uint8)
        up[same] = 1 + _least_between(padded, before[same] + 1, pos[same] + 1)
        down[follows] = 1 + _least_between(padded, pos[follows] + 1, after[follows] + 1)
        old = np.ones(n + len(new), bool)
        old[new] = False
        symbol = np.where(r < lengths[live], text[np.maximum(ends[live] - r - 1, 0)], END).astype(np.uint8)
        merged = []
        for was, put in ((bwt, symbol), (lcp, up), (who, live.astype(np.int32)), (off, (lengths[live] - r).astype(np.int16))):
            out = np.empty(len(old), was.dtype)
            out[old], out[new] = was, put
            merged.append(out)
        bwt, lcp, who, off = merged
        lcp[new[follows] + 1] = down[follows]
        more = r < lengths[live]
        live, pos = live[more], new[more]
    return who, off, lcp


def smallest_ids(strings: list[bytes], ids: np.ndarray, least: int) -> list[np.ndarray]:
    """For each string and each place in it where ``least`` bytes start: the smallest id of any string with them."""
    lengths = np.array([len(s) for s in strings], dtype=np.int64)
    out = [np.full(max(n - least + 1, 0), i, np.int64) for n, i in zip(lengths.tolist(), ids.tolist(), strict=True)]
    who, off, lcp = suffix_order(b"".join(strings), lengths)
    run = np.cumsum(lcp < least)
    keep = lengths[who] - off >= least
    who, off, run = who[keep], off[keep], run[keep]
    if len(run):
        heads = np.nonzero(np.concatenate([[True], run[1:] != run[:-1]]))[0]
        best = np.repeat(np.minimum.reduceat(ids[who], heads), np.diff(np.concatenate([heads, [len(run)]])))
        flat = np.concatenate([[0], np.cumsum(np.maximum(lengths - least + 1, 0))])
        all_ = np.concatenate(out)
        all_[flat[who] + off] = best
        out = np.split(all_, flat[1:-1])
    return out


def decide(contexts: list[bytes], hashes: np.ndarray, ids: np.ndarray, least: int) -> np.ndarray:
    """For each context of a block a bit for each of its strings: whether a smaller id than its own has the string.

    Equal contexts are one string with their smallest id. Anchors with several contexts go through the
    suffix order, some anchors at a time.
    """
    known: dict[bytes, int] = {}
    of = np.array([known.setdefault(c, len(known)) for c in contexts], dtype=np.int64)
    strings = list(known)
    smallest, h = np.full(len(strings), LAST, np.int64), np.zeros(len(strings), np.uint64)
    np.minimum.at(smallest, of, ids)
    h[of] = hashes
    best: list[np.ndarray | int] = smallest.tolist()
    order = np.argsort(h, kind="stable")
    sizes = np.array([len(strings[i]) for i in order.tolist()], dtype=np.int64)
    edge = np.nonzero(np.concatenate([[True], h[order][1:] != h[order][:-1], [True]]))[0] if len(order) else np.zeros(1, np.int64)
    todo: list[int] = []
    load = 0
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > 1:
            todo += order[a:b].tolist()
            load += int(sizes[a:b].sum())
        if todo and (load > SYMBOLS or b == len(order)):
            for i, v in zip(todo, smallest_ids([strings[i] for i in todo], smallest[todo], least), strict=True):
                best[i] = v
            todo, load = [], 0
    if todo:
        for i, v in zip(todo, smallest_ids([strings[i] for i in todo], smallest[todo], least), strict=True):
            best[i] = v
    out = np.zeros(len(contexts), np.uint64)
    for n, (i, own) in enumerate(zip(of.tolist(), ids.tolist(), strict=True)):
        b = best[i]
        if isinstance(b, int):
            out[n] = (1 << (len(contexts[n]) - least + 1)) - 1 if b < own else 0
        else:
            out[n] = int.from_bytes(np.packbits(b < own, bitorder="little").tobytes(), "little")
    return out


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows by key, of batches sorted by it."""
    at, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r[key] != at:
                yield at, rows
                rows = []
            at = r[key]
            rows.append(r)
    if rows:
        yield at, rows


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


SENT = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
SENT_SPEC = "bucket int, block string, kind int, a binary, b binary, c binary, d binary"
OUT = pa.schema([("d", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())])
OUT_SPEC = "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>, kept binary"


def _bucket_slices(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes; a bucket is the first bits of the hash."""
    buckets = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    edge = np.nonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))[0] if len(buckets) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(buckets[a]), a, b


def _shared(rows: list[dict], block: Block, bits: int) -> np.ndarray:
    """Which of a block's distinct anchors are in several documents, from the buckets' answers."""
    answers = {r["bucket"]: r["a"] for r in rows if r["kind"] == 1}
    out = np.zeros(len(block.distinct), bool)
    for bucket, a, b in _bucket_slices(block.distinct, bits):
        out[a:b] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=b - a).astype(bool)
    return out


def _context_order(hashes: np.ndarray) -> np.ndarray:
    return np.argsort(hashes, kind="stable")


def _covered(starts: np.ndarray, least: int) -> np.ndarray:
    """Which bytes of a document the strings that start at the marked places cover."""
    upto = np.cumsum(starts, dtype=np.int32)
    before = np.zeros_like(upto)
    before[least:] = upto[:-least]
    return upto > before


def _tasks(folder: str, bits: int, least: int, gram: int, kept: bool) -> list[Callable]:
    """The five maps between blocks and buckets."""

    def send_anchors(batches):
        store, path = opened(folder)
        for batch in batches:
            for name in batch.column("block").to_pylist():
                b = Block(store, path, name, least, gram)
                lo, hi = np.full(len(b.distinct), 1 << 60), np.full(len(b.distinct), -1)
                np.minimum.at(lo, b.of, b.doc)
                np.maximum.at(hi, b.of, b.doc)
                tail = (b.distinct & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]
                out = [{"bucket": k, "block": name, "kind": 0, "a": tail[i:j].tobytes(), "b": np.packbits(lo[i:j] != hi[i:j]).tobytes()} for k, i, j in _bucket_slices(b.distinct, bits)]
                yield _rows(out, SENT)

    def answer_anchors(batches):
        for bucket, rows in _runs(batches, "bucket"):
            six = np.frombuffer(b"".join(r["a"] for r in rows), np.uint8).reshape(-1, 6)
            h = np.zeros((len(six), 8), np.uint8)
            h[:, :6] = six
            sizes = [len(r["a"]) // 6 for r in rows]
            several = np.concatenate([np.unpackbits(np.frombuffer(r["b"], np.uint8), count=n) for r, n in zip(rows, sizes, strict=True)]).astype(bool)
            _, of, times = np.unique(h.view("<u8").ravel(), return_inverse=True, return_counts=True)
            shared = times > 1
            shared[of[several]] = True
            at, out = 0, []
            for r, n in zip(rows, sizes, strict=True):
                out.append({"bucket": bucket, "block": r["block"], "kind": 1, "a": np.packbits(shared[of[at : at + n]]).tobytes()})
                at += n
            yield _rows(out, SENT)

    def send_contexts(batches):
        store, path = opened(folder)
        for name, rows in _runs(batches, "block"):
            b = Block(store, path, name, least, gram)
            _, _, contexts, hashes, ids = b.contexts(_shared(rows, b, bits), least)
            order = _context_order(hashes)
            out = []
            for k, i, j in _bucket_slices(hashes[order], bits):
                o = order[i:j]
                part = [contexts[x] for x in o.tolist()]
                out.append({"bucket": k, "block": name, "kind": 0, "a": b"".join(part), "b": np.array([len(x) for x in part], "<u2").tobytes(), "c": hashes[o].tobytes(), "d": ids[o].tobytes()})
            yield _rows(out, SENT)

    def answer_contexts(batches):
        for bucket, rows in _runs(batches, "bucket"):
            contexts: list[bytes] = []
            sizes = []
            for r in rows:
                data, at = r["a"], 0
                lengths = np.frombuffer(r["b"], "<u2").tolist()
                sizes.append(len(lengths))
                for n in lengths:
                    contexts.append(data[at : at + n])
                    at += n
            hashes, ids = np.frombuffer(b"".join(r["c"] for r in rows), np.uint64), np.frombuffer(b"".join(r["d"] for r in rows), np.int64)
            bits_of = decide(contexts, hashes, ids, least)
            at, out = 0, []
            for r, n in zip(rows, sizes, strict=True):
                out.append({"bucket": bucket, "block": r["block"], "kind": 2, "a": bits_of[at : at + n].tobytes()})
                at += n
            yield _rows(out, SENT)

    def remove(batches):
        store, path = opened(folder)
        for name, rows in _runs(batches, "block"):
            b = Block(store, path, name, least, gram)
            at, of, _, hashes, ids = b.contexts(_shared(rows, b, bits), least)
            answers = {r["bucket"]: r["a"] for r in rows if r["kind"] == 2}
            masks, order = np.zeros(len(hashes), np.uint64), _context_order(hashes)
            for k, i, j in _bucket_slices(hashes[order], bits):
                masks[order[i:j]] = np.frombuffer(answers[k], np.uint64)
            # a string is marked where its context's answer has its bit, or where the context itself is in a smaller document here
            mask = np.where(b.ids[b.doc[at]] > ids[of], np.uint64(2**64 - 1), masks[of]) if len(at) else np.zeros(0, np.uint64)
            first, count = b.first[at], b.last[at] - b.first[at] + 1
            marked = np.zeros(len(b.text), bool)
            for j in range(int(count.max()) if len(count) else 0):
                hit = (count > j) & (mask >> np.uint64(j) & np.uint64(1)).astype(bool)
                marked[first[hit] + j] = True
            out, size, x = [], 0, 0
            whole = np.frombuffer(b.text, np.uint8)
            for i, length in zip(b.ids.tolist(), b.lengths.tolist(), strict=True):
                g = _covered(marked[x : x + length], least)
                step = np.diff(np.concatenate([[0], g.view(np.int8), [0]]))
                starts, ends = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
                left = whole[x : x + length][~g].tobytes()
                out.append({"d": i, "n_bytes": length, "n_removed": int(g.sum()), "n_spans": len(starts), "kept_sha256": hashlib.sha256(left).hexdigest()} | ({"starts": starts.tolist(), "ends": ends.tolist(), "kept": left} if kept else {}))
                x, size = x + length, size + len(left)
                if size > 4 << 20:
                    yield _rows(out, OUT)
                    out, size = [], 0
            yield _rows(out, OUT)

    return [send_anchors, answer_anchors, send_contexts, answer_contexts, remove]


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each row group of the folder's files."""
    from pyarrow import fs

    store, path = opened(folder)
    names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet"))

    def groups(batches):
        store, path = opened(folder)
        for batch in batches:
            out = []
            for name in batch.column("file").to_pylist():
                with store.open_input_file(f"{path}/{name}") as f:
                    out += [f"{name}#{i}" for i in range(pq.ParquetFile(f).num_row_groups)]
            yield pa.RecordBatch.from_pydict({"block": out}, schema=pa.schema([("block", pa.string())]))

    return spark.createDataFrame([(x,) for x in names], "file string").mapInArrow(groups, "block string")


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, kept: bool = True) -> DataFrame:
    """Remove from each row of docs (doc_id, text) every byte that a string of ``least`` bytes covers which
    also starts in a row with a smaller doc_id. All are judged on the input; texts are whole and in UTF-8.

    ``least`` - ``gram`` is at most 63. Null text is empty. A null doc_id is larger than any other; rows
    with equal ids do not remove each other's strings. Texts shorter than ``least`` stay. Empty input: no
    rows. A lost executor's tasks read their blocks again; the files are only read after they are written.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of the removed runs, and
    kept (binary: a run may cut a character); the last three are null unless ``kept``.
    """
    spark = docs.sparkSession
    small_batches(spark, 64)
    folder = work_path(spark, "blocks")
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    rows.write.option("parquet.block.size", str(BLOCK_BYTES)).option("compression", "zstd").parquet(folder)
    total = spark.read.parquet(folder).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, min(24, (total // BUCKET_BYTES).bit_length()))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(_blocks(spark, folder), "block-list")
    send_anchors, answer_anchors, send_contexts, answer_contexts, remove = _tasks(folder, bits, least, gram, kept)
    sent = lambda df, key: df.repartition(n, key).sortWithinPartitions("block" if key == "block" else "bucket")
    anchors_ = blocks.repartition(n, "block").mapInArrow(send_anchors, SENT_SPEC)
    shared = written(sent(anchors_, "bucket").mapInArrow(answer_anchors, SENT_SPEC), "shared")
    contexts = sent(shared, "block").mapInArrow(send_contexts, SENT_SPEC)
    answers = written(sent(contexts, "bucket").mapInArrow(answer_contexts, SENT_SPEC), "answers")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("a", "binary"), ("b", "binary"), ("c", "binary"), ("d", "binary"))]
    every = blocks.select(F.lit(-1).alias("bucket"), "block", F.lit(-1).alias("kind"), *none)
    out = sent(every.unionByName(shared).unionByName(answers), "block").mapInArrow(remove, OUT_SPEC)
    return out.select(F.nullif("d", F.lit(LAST)).alias("doc_id"), *[c for c in out.columns if c != "d"])
