"""Hard negatives, the filter audit and BPE against plain versions, and their edge cases."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm import bpe, filter_audit, hard_negatives, queries

SF = "/root/testdata/sf0.001"
VECTORS = "id long, label int, vector array<float>, rank int, key long, score long"


def plain_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    used = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for anchor, label, a in used:
        if not is_anchor(anchor):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), i, other) for i, other, b in used))
        best = [(-s, i) for s, i, other in scored if other == label and i != anchor][:positives]
        for score, positive in best:
            hard = [(i, -s) for s, i, other in scored if other != label and low * score <= -100 * s <= high * score][:negatives]
            out |= {(anchor, positive, rank, i, score, s) for rank, (i, s) in enumerate(hard, 1)}
    return out


def vectors(n, seed, dims=6):
    r = random.Random(seed)
    hot = [round(r.uniform(-1, 1), 2) for _ in range(dims)]
    return [(i, r.randrange(3) if r.random() > 0.3 else 0, hot if r.random() < 0.3 else [round(r.uniform(-1, 1), 1) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("round_bytes", [1 << 25, 200])
def test_hard_negatives(spark, round_bytes):
    """A frequent vector, a frequent label and ties, in one round and in several."""
    rows = vectors(400, 1)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS).repartition(5)
    got = hard_negatives.mine(df, df["id"] % 20 == 0, round_bytes=round_bytes)
    want = plain_negatives(rows, lambda i: i % 20 == 0)
    assert want and {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [1.0, None]), (2, 1, [float("nan"), 1.0]), (3, 1, [float("inf"), 1.0]), (4, 1, None), (5, None, [1.0, 1.0]), (None, 1, [1.0, 1.0])]
    rows += [(6, 1, [1.0]), (7, 1, []), (8, 2, [0.5, 0.1, 9.0]), (9, 2, [0.3]), (9, 2, [0.3]), (10, 1, [2.0, 1.5])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, df["id"] == 0).collect())
    a = [256, 512]
    # positives 10 (256 * 512 + 512 * 384), 6 (256 * 256) and 7 (0); 8 scores 256 * 128 + 512 * 25, 9 scores 256 * 76 twice
    near, far = a[0] * 128 + a[1] * 25, a[0] * 76
    assert got == [(0, 6, 1, 8, 65536, near)] and 50 * 65536 > 100 * far
    assert hard_negatives.mine(df.limit(0), df["id"] == 0).collect() == []
    assert hard_negatives.mine(df, df["id"] == 77).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**52), 2**52), min_size=2, max_size=2), min_size=1, max_size=4))
def test_scores_are_exact(rows):
    a = np.array(rows, float)
    want = [[sum(x * y for x, y in zip(p, q)) for q in rows] for p in rows]
    if max(abs(x) for r in want for x in r) < 2**63:
        assert hard_negatives.scores(a, a).astype(object).tolist() == want
    else:
        with pytest.raises(OverflowError):
            hard_negatives.scores(a, a)


def plain_audit(docs, labels):
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    quality, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    failing, parts = [], {}
    for i, text, source in docs:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": text in smallest and (i is None or i > smallest[text]),
        }
        parts.setdefault(source or "", []).append(({f for f in fails if fails[f]}, i in quality, i in toxic))
    out = set()
    for part, failing in parts.items():
        steps = []
        for order in permutations("ABCDE"):
            left = failing
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                unique = sum(d[0] == {f} for d in failing)
                steps.append(("".join(order), step, len(left), len(gone), sum(f in d[0] for d in failing) - len(gone), unique, sum(d[1] for d in gone), sum(d[2] for d in gone)))
        for s in steps:
            f = s[0][s[1] - 1]
            out.add((part, *s, sum(x[3] for x in steps if x[0][x[1] - 1] == f)))
    return out


def audited():
    r = random.Random(5)
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", long, long + " #", long + " X" * 40, "a b a b a", long + " x" * 400, "A\x1cB C", "é" * 300, "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 3]
    docs = [(r.choice([None, *range(40)]), texts[0 if r.random() < 0.3 else r.randrange(len(texts))], r.choice([None, "", "s1", "s2"])) for _ in range(300)]
    return docs, [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 40, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]


@pytest.mark.parametrize("held", [16 << 20, 1000])
def test_filter_audit(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD", held)
    docs, labels = audited()
    df = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, source string, part int, mask long, n long").repartition(6)
    got = filter_audit.audit(df, spark.createDataFrame([(*x, 7) for x in labels], "doc_id long, quality int, toxic int, good int"))
    assert {tuple(r) for r in got.collect()} == plain_audit(docs, labels) and got.count() == 120 * 5 * 3
    assert filter_audit.audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_texts_of_one_fingerprint_stand_in_a_chain():
    chains = filter_audit.Chains()
    rows = lambda: filter_audit.Counter({("p", 0): 1})
    assert chains.add(7, b"x", 5, rows()) is None and chains.add(7, b"y", 6, rows()) is None
    assert chains.add(7, b"y", 9, rows()) == (9, rows()) and chains.add(7, b"x", 3, rows()) == (5, rows())
    assert chains.add(7, b"x", 3, rows()) is None
    assert [e[1][:2] for e in chains.taken()] == [(b"x", 3), (b"y", 6)] and list(chains.taken()) == []


@pytest.fixture(scope="module")
def source():
    return bpe.read_tokenizer(queries.tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library(source):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(source)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def coder(source):
    return bpe.Coder(source)


def same(coder, library, texts):
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False), repr(text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=20))
def test_bpe_of_any_texts(coder, library, texts):
    same(coder, library, texts)


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_bpe_of_tokens_put_together(coder, library, data):
    tokens = sorted(library.get_vocab())
    words = st.lists(st.sampled_from(tokens), min_size=1, max_size=6).map(lambda ts: "".join(t.replace("</w>", "") for t in ts))
    same(coder, library, data.draw(st.lists(words, min_size=1, max_size=30)))


def test_bpe_of_long_words_and_special_strings(coder, library):
    r = random.Random(2)
    texts = ["".join(r.choice("aehlostx") for _ in range(n)) for n in (63, 64, 65, 3000)] + ["ha" * 4000, "\U0001f602" * 500]
    same(coder, library, [*texts, "a<|endoftext|>b<|startoftext|><|endoftext", " <|EndOfText|> ", "ΣΑΣ ΑΣ. İx", "x\x1cy\x00 \x85z", "é ﬁ Ω", ""])


def test_failing_words_alone_are_merged(coder):
    words = ["house", "xqzwvk", "thethethe", "antidisestablishment"]
    split, merged = coder.bpe.words(words)
    assert [s.tolist() for s in split] == [coder.bpe.merged(w) for w in words]
    greedy = [coder.bpe.proposed(w) == coder.bpe.merged(w) for w in words]
    assert merged >= greedy.count(False) and coder.bpe.words(["house"])[1] == 0


def test_bpe_roundtrip_of_the_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op13_bpe_roundtrip(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_rows(spark, edges, nothing, source, library):
    from .conftest import EDGES

    out = bpe.decode(bpe.encode(edges, source), source).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in EDGES]
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in out), key=str) == sorted(want, key=str)
    assert bpe.encode(nothing, source).count() == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray(np.array([99999, 320], "<u4").tobytes()))], "doc_id long, ids binary")
    assert {r.doc_id: r.text for r in bpe.decode(odd, source).collect()} == {1: "", 2: library.decode([320], skip_special_tokens=False)}


def test_another_tokenizer_file_is_an_error():
    with pytest.raises(ValueError):
        bpe.Bpe(bpe.read_tokenizer(queries.tokenizer_path("byte_bpe_50k.json")))
