"""Token counts: pieces are counted once per distinct pre-token and joined to pre-token frequencies."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .common import small_batches

#: The tokenizer's published pre-token pattern (byte-level BPE); fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Its special token, which the library takes whole wherever it stands in a text; fixed value.
SPECIAL = "<|endoftext|>"
#: The known set holds at most so many pre-tokens of at most so many characters, so under 20 MB; for it at most so many
#: characters of a task's input are looked at.
KNOWN, KNOWN_CHARS, HEAD_CHARS = 100_000, 32, 4_000_000
#: A text that tells pre-token patterns apart.
PROBE = "I'll see 12,345 things, don't   stop:\n\n  été x9\t!! WE'RE ok_1 "

#: Characters outside these ranges may have another class in the regex module's Unicode tables than in
#: the library's; texts that hold one are split by the library's own pre-tokeniser, which is slower.
UNSURE = r"[^\u0000-\u0557\u2010-\u205e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3]"


def finder(path: str, pattern: str = PRE_TOKEN):
    """A function from a text to its pre-tokens."""
    import regex

    plain, unsure, exact = regex.compile(pattern).findall, re.compile(UNSURE).search, _tokenizer(path).pre_tokenizer.pre_tokenize_str
    return lambda text: [text[a:b] for _, (a, b) in exact(text)] if unsure(text) else plain(text)


def pre_token_counts(text: str, find, special: str = SPECIAL) -> Counter:
    """How often each pre-token occurs. Special strings are pre-tokens of their own."""
    if special and special in text:
        counts: Counter = Counter()
        parts = text.split(special)
        for part in parts:
            counts.update(find(part))
        counts[special] += len(parts) - 1
        return counts
    return Counter(find(text))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer file, loaded once in each worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def check_tokenizer(path: str, pattern: str, special: str) -> None:
    """An error for a tokenizer file that doesn't work as ``pattern`` and ``special`` say."""
    import regex

    tokenizer = _tokenizer(path)
    added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    split = [PROBE[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(PROBE)] if tokenizer.pre_tokenizer else [PROBE]
    if tokenizer.normalizer is not None or added - {special} or split != regex.findall(pattern, PROBE):
        raise ValueError(f"{path} normalises texts, has other added tokens than {special!r}, or does not split texts by the pattern")


def _pieces(path: str, pre_tokens: list[str]) -> list[int]:
    tokenizer = _tokenizer(path)
    return [len(e) for i in range(0, len(pre_tokens), 1000) for e in tokenizer.encode_batch(pre_tokens[i : i + 1000], add_special_tokens=False)]


def count_tokens(docs: DataFrame, path: str, pattern: str = PRE_TOKEN, special: str = SPECIAL, head_rows: int = 2000) -> DataFrame:
    """Tokens of each row of docs (doc_id, text) under the tokenizer file at ``path``.

    The most frequent pre-tokens of about ``head_rows`` rows, the first ones of every partition (KNOWN
    pre-tokens at most), are counted first and sent to all tasks; that bounded set only saves shuffling and
    does not change a result. Each document's
    frequencies of known pre-tokens are summed where it is read; the others go, as (row, pre-token,
    frequency), through a join with the counts of the distinct pre-tokens, each tokenised once.
    Frequent pre-tokens never meet in one task, and no token ids are made.

    Null text is empty: 0 tokens. Very long texts are read whole. Repeated rows are counted each. Empty
    input: no rows. A tokenizer file that needs another pattern is an error.
    Returns doc_id, n_bytes, n_tokens.
    """
    spark = docs.sparkSession
    small_batches(spark)
    check_tokenizer(path, pattern, special)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    each = -(-head_rows // max(1, texts.rdd.getNumPartitions()))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts, rows, size = finder(path, pattern), Counter(), 0, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                rows, size = rows + 1, size + len(text)
                if rows > each or size > HEAD_CHARS:
                    break
                counts.update({k: n for k, n in pre_token_counts(text, find, special).items() if len(k) <= KNOWN_CHARS})
            if rows >= each or size > HEAD_CHARS:
                break
        out = counts.most_common(KNOWN)
        yield pa.RecordBatch.from_pydict({"k": [k for k, _ in out], "n": [n for _, n in out]}, schema=pa.schema([("k", pa.string()), ("n", pa.int64())]))

    known: list[str] = []
    if head_rows:
        small_batches(spark, min(1000, each))
        top = texts.mapInArrow(frequent, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").limit(KNOWN)
        known = [r.k for r in top.toLocalIterator()]
        small_batches(spark)
    sent = spark.sparkContext.broadcast(dict(zip(known, _pieces(path, known), strict=True)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, pieces = finder(path, pattern), sent.value
        for batch in batches:
            out: dict = {"row_id": batch.column("row_id"), "doc_id": batch.column("doc_id"), "n_bytes": [], "known": [], "rare": [], "times": []}
            for text in batch.column("text").to_pylist():
                total, rare, times = 0, [], []
                for k, n in pre_token_counts(text, find, special).items():
                    if (c := pieces.get(k)) is None:
                        rare.append(k)
                        times.append(n)
                    else:
                        total += c * n
                out["n_bytes"].append(len(text.encode()))
                out["known"].append(total)
                out["rare"].append(rare)
                out["times"].append(times)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("known", pa.int64()), ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"pre_token": batch.column("pre_token"), "pieces": _pieces(path, batch.column("pre_token").to_pylist())}, schema=pa.schema([("pre_token", pa.string()), ("pieces", pa.int32())]))

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    split_rows = written(rows.mapInArrow(split, "row_id long, doc_id long, n_bytes long, known long, rare array<string>, times array<int>"), "pre-tokens")
    freq = split_rows.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("z")).select("row_id", F.col("z.rare").alias("pre_token"), F.col("z.times").alias("times"))
    pieces = freq.select("pre_token").distinct().mapInArrow(count, "pre_token string, pieces int")
    rest = freq.join(pieces, "pre_token").groupBy("row_id").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    return split_rows.select("row_id", "doc_id", "n_bytes", "known").join(rest, "row_id", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).cast("long").alias("n_tokens"))
