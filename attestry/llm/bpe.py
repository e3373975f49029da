"""BPE by speculation: greedy longest matches are proposed, checked pair by pair, and merged exactly where a check fails."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The tokenizer's published pre-token pattern; fixed value.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters outside these ranges may have another class or another lower case in Python's Unicode tables than in the
#: library's; texts that hold one are normalised and split by the library's own components, which is slower.
UNSURE = r"[^\u0000-ͷ΄-Ֆ‐-⁞₠-₿ぁ-ゖァ-ヾ一-龥가-힣]"
#: Texts of these characters have words whose characters stand for their own bytes.
PLAIN = r"[\x09-\x0D\x20-\x7E]*"
#: A worker remembers at most so many words of at most so many characters.
REMEMBERED, WORD_CHARS = 400_000, 64
#: Marks special strings among words; words have no spaces.
SPECIAL = " "
#: No merge.
NEVER = np.int64(1 << 40)


def byte_characters() -> str:
    """The printable character that stands for each byte: itself if Latin-1 prints it, else the next one from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        plain = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD
        out.append(chr(b if plain else spare))
        spare += not plain
    return "".join(out)


class Bpe:
    """Encoder and decoder of a tokenizer file with word-end tokens.

    A token's place in the list of merges is its rank (-1 for single characters). A split into tokens is what merging by
    rank would leave if every token is what its own characters merge to, and no merge ever crosses the seam between two
    neighbours, which depends on these two alone.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not self.suffix or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("not a BPE file with word ends and neither dropout, byte fallback nor a decoder")
        self.table = byte_characters()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must be taken as they stand")
        size = max(chain(vocab.values(), self.special.values())) + 1
        self.text = np.full(size, None, dtype=object)
        for token, i in chain(vocab.items(), self.special.items()):
            self.text[i] = token
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left, self.right, self.rank = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
        made, tokens = [], []
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            i = vocab[a + b]
            tokens.append(i)
            self.merge.setdefault(vocab[a] << 32 | vocab[b], (rank, i))
            if self.rank[i] < 0:
                self.left[i], self.right[i], self.rank[i] = vocab[a], vocab[b], rank
                made.append(i)
        self.made = np.array(tokens, np.int64)
        self.codes = np.array(sorted(self.merge), np.int64)
        self.ranks = np.array([self.merge[int(c)][0] for c in self.codes], np.int64)
        self._sort_out(vocab, np.array(made, np.int64))

    def _sort_out(self, vocab: dict, made: np.ndarray) -> None:
        """Which tokens are proposed: single characters, and those that their own characters merge to."""
        own = self.rank < 0
        fine = self.compatible(self.left[made], self.right[made], inside=True)
        for i, good in zip(made, fine, strict=True):  # in the order of ranks, so parts come first
            own[i] = good and own[self.left[i]] and own[self.right[i]]
        self.base: dict[str, int] = {c: vocab[c] for c in self.table}
        self.base_last: dict[str, int] = {c: vocab[c + self.suffix] for c in self.table}
        last = set(self.base_last.values())
        for i in made:
            if int(self.right[i]) in last:
                last.add(int(i))
        proposed = [*self.base.values(), *self.base_last.values(), *(int(i) for i in made if own[i])]
        cut = len(self.suffix)
        self.ends = {self.text[i][:-cut]: i for i in proposed if i in last}
        self.inner = {self.text[i]: i for i in proposed if i not in last}
        self.longest_end = max(map(len, self.ends))
        # by the first two characters
        self.longest: dict[str, int] = {}
        for token in self.inner:
            self.longest[token[:2]] = max(self.longest.get(token[:2], 1), len(token))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, inside: bool = False) -> np.ndarray:
        """Whether no merge crosses the seam of each pair, for all pairs at once.

        Backwards through the merges that made a and b, the characters at the seam belong to ever smaller tokens x and y.
        A merge of x and y crosses if it comes before the one that x goes into, and no later than the one that y goes
        into (of equal ones the left one is first). ``inside``: the pair's own merge doesn't count.
        """
        x, y = a.copy(), b.copy()
        x_until, y_until = np.full(len(a), NEVER - 1), np.full(len(a), NEVER - 1)
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        first = inside
        while len(open_):
            i = open_
            crossing = self._ranks(x[i], y[i])
            bad = (crossing < x_until[i]) & (crossing <= y_until[i]) & (not first)
            first = False
            good[i[bad]] = False
            i = i[~bad & ((self.rank[x[i]] >= 0) | (self.rank[y[i]] >= 0))]
            back = self.rank[x[i]] > self.rank[y[i]]
            p, q = i[back], i[~back]
            x_until[p], x[p] = self.rank[x[p]], self.right[x[p]]
            y_until[q], y[q] = self.rank[y[q]], self.left[y[q]]
            open_ = i
        return good

    def proposed(self, word: str) -> list[int]:
        """Longest matches from the left; the last one bears the word's end."""
        out, at, n, ends, inner, longest = [], 0, len(word), self.ends, self.inner, self.longest
        while True:
            if n - at <= self.longest_end and (end := ends.get(word[at:])) is not None:
                out.append(end)
                return out
            for stop in range(min(n - 1, at + longest.get(word[at : at + 2], 1)), at, -1):
                if (i := inner.get(word[at:stop])) is not None:
                    out.append(i)
                    at = stop
                    break

    def merged(self, word: str) -> list[int]:
        """Merging by rank, leftmost first, in O(n log n)."""
        ids = [self.base[c] for c in word[:-1]] + [self.base_last[word[-1]]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(n - 1) if (m := self.merge.get(ids[k] << 32 | ids[k + 1]))]
        heapq.heapify(heap)
        while heap:
            _, k, new, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = new, -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (m := self.merge.get(ids[left] << 32 | ids[right])):
                    heapq.heappush(heap, (m[0], left, m[1], ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def words(self, words: list[str]) -> tuple[list[np.ndarray], int]:
        """Tokens of each word, and how many words had to be merged."""
        if not words:
            return [], 0
        split = [self.proposed(w) for w in words]
        flat = np.fromiter(chain.from_iterable(split), np.int64)
        ends = np.cumsum([len(s) for s in split])
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        seam = np.flatnonzero(word[1:] == word[:-1])
        code, place = np.unique(flat[seam] << 32 | flat[seam + 1], return_inverse=True)
        good = self.compatible(code >> 32, code & 0xFFFFFFFF)
        wrong = np.unique(word[seam[~good[place]]])
        out = np.split(flat, ends[:-1])
        short = [k for k in wrong if len(words[k]) <= WORD_CHARS]
        for k, ids in zip(short, self.merged_together([words[k] for k in short]), strict=True):
            out[k] = ids
        for k in wrong:
            if len(words[k]) > WORD_CHARS:
                out[k] = np.array(self.merged(words[k]), np.int64)
        return out, len(wrong)

    def merged_together(self, words: list[str]) -> list[np.ndarray]:
        """Merging by rank, leftmost first, one merge of every word at a time."""
        out: list = [None] * len(words)
        ids = np.fromiter(chain.from_iterable(([self.base[c] for c in w[:-1]] + [self.base_last[w[-1]]]) for w in words), np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        seams = self._seams(ids, word)
        while len(ids):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(starts, append=len(word))
            least = np.minimum.reduceat(seams, starts)
            if (done := least == NEVER).any():
                for k, first, n in zip(word[starts[done]], starts[done], sizes[done], strict=True):
                    out[k] = ids[first : first + n].copy()
                keep = np.repeat(~done, sizes)
                ids, word, seams = ids[keep], word[keep], seams[keep]
                continue
            at = np.flatnonzero(seams == np.repeat(least, sizes))
            at = at[np.flatnonzero(np.diff(word[at], prepend=-1))]
            ids[at] = self.made[seams[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            ids, word, seams = ids[keep], word[keep], seams[keep]
            near = np.concatenate([at, at[at > 0] - 1])
            seams[near] = self._seams(ids, word, near)
        return out

    def _seams(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The rank of the merge of each token with the next one of its word."""
        at = np.arange(len(ids)) if at is None else at
        after = np.minimum(at + 1, len(ids) - 1)
        return np.where((word[at] == word[after]) & (at != after), self._ranks(ids[at], ids[after]), NEVER)


class Coder:
    """Texts to ids and back, in a worker: splits texts into words and remembers words."""

    def __init__(self, source: str):
        import os

        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.bpe = Bpe(source)
        library = Tokenizer.from_str(source)
        self.normal, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.find, self.unsure = regex.compile(PRE_TOKEN).findall, re.compile(UNSURE).search
        self.plain = re.compile(PLAIN).fullmatch
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")") if self.bpe.special else None
        self.letters = dict(enumerate(self.bpe.table))
        self.whole = {SPECIAL + t: np.array([i], "<u4").tobytes() for t, i in self.bpe.special.items()}
        self.known: dict[str, bytes] = dict(self.whole)
        probe = "I'll SEE 12 things, don't\n\n  été ΣΣ x9!! WE'RE ok_1 İ"
        if self.split(probe) != self.slow_split(probe):
            raise ValueError("the tokenizer file normalises or splits texts in another way")

    def slow_split(self, text: str) -> list[str]:
        return [word for word, _ in self.cut(self.normal(text))]

    def split(self, text: str) -> list[str]:
        """Words of a text without special strings, one character a byte."""
        if self.unsure(text):
            return self.slow_split(text)
        text = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        found = self.find(text.lower())
        return found if self.plain(text) else [w if self.plain(w) else w.encode().decode("latin-1").translate(self.letters) for w in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [[w for k, piece in enumerate(self.specials.split(t)) for w in ((SPECIAL + piece,) if k % 2 else self.split(piece))] if self.specials and self.specials.search(t) else self.split(t) for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = dict(self.whole)
            new = list(set(chain.from_iterable(parts)).difference(self.known))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            self.known.update(zip(some, (i.astype("<u4").tobytes() for i in self.bpe.words(some)[0]), strict=True))
        out = [b"".join(map(self.known.__getitem__, words)) for words in parts]
        for w in new:
            if len(w) > WORD_CHARS:
                del self.known[w]
        return out

    def decode(self, ids: bytes) -> str:
        """Tokens with spaces between; ids that no token has are left out."""
        ids = np.frombuffer(ids, "<u4")
        tokens = self.bpe.text[ids[ids < len(self.bpe.text)]].tolist()
        return " ".join([t for t in tokens if t is not None])


@lru_cache(maxsize=2)
def _coder(source: str) -> Coder:
    return Coder(source)


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _in_pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[tuple[pa.Array, list]]:
    """(doc_ids, values of a column), some MB at a time."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit)))
            part = batch.slice(at, end - at)
            yield part.column("doc_id"), part.column(column).to_pylist()
            at = end


def encode(docs: DataFrame, source: str) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): the ids of the whole text, packed as little-endian unsigned 32-bit integers;
    ``source`` is the tokenizer file's content.

    Texts stay in their task: the distinct new words of some MB are proposed and checked together, and short words are
    remembered (a bounded number). Special strings in a text are their tokens. Null and empty texts have no ids, repeated
    rows are encoded each, other columns are ignored. Empty table: no rows. A file of another kind is an error.
    """
    sent = docs.sparkSession.sparkContext.broadcast(source)
    _coder(source)  # an error is raised here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value)
        for ids, texts in _in_pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([ids, pa.array(coder.encode([t or "" for t in texts]), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, source: str) -> DataFrame:
    """Add text to (doc_id, ids): the tokens, special ones too, with spaces between. Ids that the file does not have are
    left out; null ids are none."""
    sent = encoded.sparkSession.sparkContext.broadcast(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value)
        for key, ids in _in_pieces(batches, "ids"):
            yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.binary()), pa.array([coder.decode(i or b"") for i in ids], pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
