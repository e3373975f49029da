"""Operators that SQL can't express, against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from attestry.llm import decontamination, merkle, mixing, queries, sharding, simhash, suffixes, token_counts, toxicity
from attestry.operators import alike
from attestry.storage import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def components(nodes, linked):
    """Smallest node of each node's component, by all pairs."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def plain_simhash(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash_pivots(spark, SF).collect()}
    prints = {i: plain_simhash(t) for i, t in docs.items()}
    want = components(docs, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in docs}


@pytest.mark.parametrize("hot", [7, 10_000])
def test_simhash_links_of_crowded_buckets(spark, hot):
    """Many fingerprints around a few centres, and buckets split or not."""
    r = random.Random(1)
    centres = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({c ^ sum(1 << r.randrange(64) for _ in range(r.randrange(5))) & (2**64 - 1) for c in centres for _ in range(60)})
    signed = [f - (f >> 63 << 64) for f in fps]
    want = components(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "node long, fp long")
    links = simhash.similar(prints, simhash.block_masks(3), 3, hot=hot).collect()
    assert all((fps[x.a] ^ fps[x.b]).bit_count() <= 3 for x in links)
    pairs = {(min(x.a, x.b), max(x.a, x.b)) for x in links}
    assert components(range(len(fps)), lambda a, b: (a, b) in pairs) == want


def test_mix_is_the_same_again_and_near_its_targets(spark):
    a, b = (sorted(map(tuple, queries.op2_source_mix(spark, "/root/testdata/sf0.01").collect())) for _ in range(2))
    assert a == b
    rows = queries.op2_source_mix(spark, "/root/testdata/sf0.01").collect()
    source = {r.doc_id: r.source for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source").collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r["size"])
    assert abs(sum(taken.values()) - sum(target.values())) <= max(largest.values())
    assert all(abs(taken[s] - target[s]) <= largest[s] + 0.1 * target[s] for s in target)


def test_shards_are_near_equal(spark):
    rows = queries.op3_kd_shards(spark, "/root/testdata/sf0.01").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all(r["size"] == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    size, slots = Counter(), {}
    for r in rows:
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(size) == set(range(8)) and max(size.values()) <= 1.1 * min(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def plain_tree(rows, leaves=None, target=None):
    """Leaf of each row, by sorting whole nodes. rows: (key, weight, (x0, x1, x2, x3), tie)."""
    extent = [max(r[2][d] for r in rows) - min(r[2][d] for r in rows) for d in range(4)]
    out, done = {}, 0

    def split(part, n):
        nonlocal done
        w = sum(r[1] for r in part)
        n = n if target is None else max(1, -(-w // target))
        cut = None
        if n > 1:
            wide = [(max(r[2][d] for r in part) - min(r[2][d] for r in part)) / extent[d] if extent[d] else 0 for d in range(4)]
            d, goal, upto = wide.index(max(wide)), w * (n // 2) / n, 0
            groups: dict = {}
            for r in part:
                groups.setdefault((r[2][d], r[3]), []).append(r)
            for k in sorted(groups):
                own = sum(r[1] for r in groups[k])
                if upto + own >= goal:
                    cut = k if goal - upto >= own / 2 or not upto else (k[0], k[1] - 1)
                    break
                upto += own
            left, right = ([r for r in part if ((r[2][d], r[3]) <= cut) == side] for side in (True, False))
            if left and right:
                split(left, n // 2)
                split(right, n - n // 2)
                return
        out.update({r[0]: done for r in part})
        done += 1

    split(rows, leaves)
    return out


@pytest.mark.parametrize("shards, target", [(8, None), (None, 20_000)])
def test_tree_is_the_plain_one(spark, shards, target):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.shard for r in sharding.kd_shards(df, shards, target).select("row.doc_id", "shard").collect()}
    rank = lambda c: {v: i for i, v in enumerate(sorted({r[0] for r in df.select(c).collect()}), 1)}
    source, lang = rank("source"), rank("lang")
    rows = [(r.x0, r["size"], (r.x0, r.x1, source[r._source], lang[r._lang]), r.tie) for r in sharding._measured(df).drop("row").collect()]
    want = plain_tree(rows, shards, target)
    groups = lambda m: {frozenset(k for k in m if m[k] == s) for s in set(m.values())}
    assert groups(got) == groups(want)
    assert got == want if target is None else len(set(want.values())) > 4


def plain_leaks(docs, items):
    """(doc, item) pairs that share 0.8 of the item's five-word windows as they are."""
    words = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t)]
    grams = lambda t: {i: tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    own = {i: grams(t) for i, t in items.items()}
    out = set()
    for d, t in docs.items():
        have = set(grams(t).values())
        out |= {(d, i) for i, g in own.items() if g and sum(x in have for x in g.values()) >= 0.8 * len(g)}
    return out


def test_leaks_of_verbatim_passages(spark, docs):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op4_template_leaks(spark, SF).collect()}
    want = plain_leaks(docs, items)
    assert want and want <= got and got == want


def test_leaks_with_other_parameters(spark):
    item = "If Alice has 12 apples and gives Bob 5 apples how many apples does Alice have left after that day."
    texts = {
        1: "Once more. If Carol has 31 apples and gives Dave 7 apples how many apples does Carol have left after that day. End.",
        2: item.upper(),
        3: "If Carol went home and has some pears then nobody gives Dave seven of them and that is all there is to say.",
        4: item.replace("Alice", "Zoe").replace("12", "99"),
    }
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.leaks(d, b).collect()) == [1, 2, 4]


def plain_templates(docs, items, share=0.8):
    """(doc, item) pairs, by every alignment of every pair; items of eight words or more."""
    t, out = decontamination.Templates(), set()
    seen = {d: t.tokens(x) for d, x in docs.items()}
    for i, x in items.items():
        words, plain, template, slot = t.tokens(x)
        low, at = [w.lower() for w in words], range(len(words) - 4)
        judged = [p for p in at if slot[p : p + 5].sum() <= 3] or list(at)
        for d, (dw, dp, dt, ds) in seen.items():
            low_d, good = [w.lower() for w in dw], set()
            for shift in range(-len(words), len(dw)):
                met, same = {}, set()
                for p in judged:
                    q = p + shift
                    if q < 0 or q + 5 > len(dw):
                        continue
                    if low[p : p + 5] == low_d[q : q + 5]:
                        same.add(p)
                    if 0 < slot[p : p + 5].sum() <= 3 and 0 < ds[q : q + 5].sum() <= 3 and (template[p : p + 5] == dt[q : q + 5]).all():
                        met[p] = [low[p + k] for k in range(5) if slot[p + k]], [low_d[q + k] for k in range(5) if ds[q + k]]
                hits = [{"item_pos": p, "item_slots": a, "slots": b} for p, (a, b) in met.items()] + [{"item_pos": p, "item_slots": [], "slots": []} for p in same]
                good |= decontamination.consistent(hits)[0]
            if len(good) >= share * len(judged):
                out.add((d, i))
    return out


def word_problem(r, kind, changed):
    """One of some word problems with names, numbers and units of its own."""
    name, n = lambda: r.choice(["Alice", "Bob", "Carol", "Dave", "Erin", "Frank", "Grace", "Heidi"]), lambda: str(r.choice([3, 12, 31, 950, "1,250", "12.50", "seven", "twelve"]))
    a, b = name(), name()
    return [
        lambda: f"{a} has {n()} apples in a basket. {b} gives {a} {n()} more apples on the way home. How many apples does {a} have now?",
        lambda: f"A train leaves the station at noon and travels {n()} miles before it stops for water. {a} rides it for {n()} hours. What was its average speed on that day?",
        lambda: f"{a} buys {n()} kg of flour and {b} buys half as much sugar at the market. Together they pay {n()} dollars. What does one bag of flour cost them?",
        lambda: f"Before the race {a} drinks {n()} ml of water and walks around the old lake twice. Afterwards {b} counts {n()} swans. How many birds did nobody count?",
    ][kind]() + (" Explain every step." if changed else "")


def test_questions_with_other_names_and_numbers(spark):
    """Re-parameterised items are found inside longer texts, and nothing else is."""
    r = random.Random(8)
    items = {k: word_problem(r, k, False) for k in range(4)} | {9: "Which river runs through the old capital of the northern kingdom and into the bay?"}
    filler = lambda: " ".join(r.choice("the of a river apples basket and miles train for water while two people walk home slowly".split()) for _ in range(30))
    docs = {i: f"{filler()}. {word_problem(r, i % 4, True)} {filler()}." for i in range(40)} | {100 + i: f"{filler()} {r.choice(['Alice', 'Bob'])} has {i} apples." for i in range(40)}
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == plain_templates(docs, items)
    found = sum((i, i % 4) in got for i in range(40))
    assert found >= 36 and not {p for p in got if p[0] >= 100 or p[0] % 4 != p[1]}, found


def test_short_items_and_joined_units(spark):
    docs = {1: "It was said that tiny item here is one of them all.", 2: "A sack weighs 19kg when full and the cart can hold five such sacks at once.", 3: "tiny thing"}
    items = {1: "Tiny item here", 2: "A sack weighs 12kg when full and the cart can hold five such sacks at once.", 3: "tiny thing", 4: "that tiny"}
    got = decontamination.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_slots_must_be_consistent():
    hit = lambda p, a, b: {"item_pos": p, "item_slots": a, "slots": b}
    good, changed = decontamination.consistent([hit(0, ["12"], ["7"]), hit(1, ["12", "5"], ["7", "9"]), hit(2, ["12"], ["8"]), hit(3, [], [])])
    assert good == {0, 1, 3} and changed == 2


def test_tokens_are_the_library_s(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    texts = docs | {-1: "a<|endoftext|>b <|endoftext|>", -2: "I'll  \n\n it's\t12,345  ꟎x \U0001f600 日本語テキスト", -3: "x" * 5000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for head in (0, 50):
        got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, queries.tokenizer_path(), head_rows=head).collect()}
        assert got == {i: len(t.encode(x, add_special_tokens=False)) for i, x in texts.items()}


def test_sure_characters_are_split_alike():
    path = queries.tokenizer_path()
    find, exact = token_counts.finder(path), token_counts._tokenizer(path).pre_tokenizer.pre_tokenize_str
    sure = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not re.search(token_counts.UNSURE, chr(c))]
    assert len(sure) > 30_000
    for i in range(0, len(sure), 7):
        s = "".join(f"a{chr(c)}b {chr(c)}1 {chr(c)} " for c in sure[i : i + 7])
        assert find(s) == [s[a:b] for _, (a, b) in exact(s)]


def test_archives_give_pages_back(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op6_warc_roundtrip(spark, SF).collect()}
    first: dict = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for i, html in pages.items():
        r, b = got[i], html.encode()
        assert r.payload_bytes == len(b) and hashlib.sha1(b).hexdigest() == __import__("base64").b32decode(r.payload_digest).hex()
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == i else ("revisit", first[html]))


def test_archives_are_the_same_again(spark):
    from attestry.llm import warc
    from attestry.storage import work_path

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    made = [sorted((r.file, r.sha256) for r in warc.write_archives(pages, work_path(spark, "warc"), shard_bytes=50_000, roll_bytes=4_000).collect()) for _ in range(2)]
    assert made[0] == made[1] and len(made[0]) > 3


def test_shards_of_archives_follow_the_bytes(spark):
    """Far and missing ids, and ids that many rows share: no shard holds over twice its bytes."""
    from attestry.llm import warc
    from attestry.storage import work_path

    r = random.Random(4)
    ids = [*range(100), 10**15, *[None] * 150, *[7] * 150]
    pages = spark.createDataFrame([(i, f"http://a/{n}", f"{n:06d}" + "".join(r.choice("abcdef") for _ in range(994))) for n, i in enumerate(ids)], "page_id long, url string, html string")
    folder = work_path(spark, "warc")
    made = warc.write_archives(pages, folder, shard_bytes=20_000).collect()
    held = Counter()
    for m in made:
        held[m.shard] += m.records * (1000 + warc.HEAD_BYTES)
    assert sum(m.records for m in made) == len(ids) and len(held) > 20 and max(held.values()) <= 40_000
    assert warc.read_archives(spark, folder).count() == len(ids)


def test_insertions_move_few_leaves(spark):
    r = random.Random(6)
    long = " ".join("".join(r.choice("eeeettaaooiinnsshhrrddlucmfwygpbvk") for _ in range(r.randrange(2, 9))) for _ in range(400))
    texts = [(long, "X" + long), (long, long[:900] + "y" + long[900:]), ("a\n\nb", "a\n\n\n\nb"), (f"one line\n\n{long}\nlast", f"one line\n\n{long[:500]}z{long[500:]}\nlast")]
    df = spark.createDataFrame(texts, "a string, b string").select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    rows = df.select("a", "b", merkle.likeness(F.col("a"), F.col("b")).alias("near"), merkle.differing(F.col("a"), F.col("b")).alias("differs")).collect()
    assert [x.near >= 0.9 for x in rows] == [True, True, False, True] and all(x.a.split(":")[0] != x.b.split(":")[0] for x in rows)
    assert [tuple(d) for d in rows[3].differs] == [("a", 1, 0), ("b", 1, 0)]


def plain_repeats(docs, least=50):
    first: dict = {}
    for i in sorted(docs):
        b = docs[i].encode()
        for k in range(len(b) - least + 1):
            first.setdefault(b[k : k + least], i)
    out = {}
    for i, t in docs.items():
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < i:
                gone[k : k + least] = True
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_order(spark, SF).collect()}
    assert got == plain_repeats(docs)


def test_repeats_of_few_symbols(spark):
    """Many ties, overlaps and self-overlaps; small blocks of text."""
    r = random.Random(3)
    parts = ["".join(r.choice("ab") for _ in range(r.choice((30, 49, 50, 51, 120)))) for _ in range(8)] + ["a" * 130, "é" * 60]
    texts = {i: "".join(r.choice(parts) for _ in range(r.randrange(5))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixes.remove_repeats(df, kept=False).collect()}
    assert got == plain_repeats(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\x00é", max_size=12).map(str.encode), min_size=1, max_size=8))
def test_suffix_order(strings):
    who, off, lcp = suffixes.suffix_order(b"".join(strings), np.array([len(s) for s in strings], dtype=np.int64))
    got = [(strings[w][o:], w) for w, o in zip(who.tolist(), off.tolist(), strict=True)]
    assert sorted(zip(who.tolist(), off.tolist(), strict=True)) == [(i, o) for i, s in enumerate(strings) for o in range(len(s) + 1)]
    assert [x for x, _ in got] == sorted(x for x, _ in got)
    for i in range(1, len(got)):
        a, b = got[i - 1][0], got[i][0]
        assert lcp[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_windows_and_distances():
    """Windows are the whole text; a distance is what two fresh compressors say."""
    text = "Über " * 30 + "x" * 200 + " the cat sat on the mat" * 9
    for size in (1, 7, 32):
        w = toxicity.windows(text, size)
        assert b"".join(w) == text.lower().encode() and max(map(len, w)) <= size
    assert toxicity.windows(None, 8) == [b""]
    clean, rude = ("the weather in the north is mild and the ferries run on time " * 3, "you are such a blithering nincompoop and everybody knows it " * 3)
    model = toxicity.fit([(f"{i} {rude if i % 2 else clean} {i * 7}", i % 2, i % 3) for i in range(60)])
    scorer = model.scorer()
    assert scorer.score("well " + rude) > 0.9 and scorer.score("well " + clean) < 0.1
    view, ordinary, toxic = model.dictionaries[0]
    import zstandard as zs

    def size(d, w):
        how = zs.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=3, min_match=view.match, target_length=64, strategy=zs.STRATEGY_BTLAZY2, write_content_size=False, write_dict_id=False, write_checksum=False)
        return len(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how).compress(w))

    d = [size(ordinary, w) - size(toxic, w) for w in toxicity.windows(rude, view.window)]
    n = len(toxicity.THRESHOLDS)
    x = scorer.features(["", rude, clean, "two words", rude])
    assert (x[1] == x[4]).all() and (x[1] == scorer.features([rude])[0]).all()
    assert x[1, 1 + n : 1 + 2 * n].tolist() == [sum(v >= k for v in d) / len(d) for k in toxicity.THRESHOLDS]
    assert x[1, 1 + 2 * n : 4 + 2 * n].tolist() == pytest.approx([max(d), sum(d) / len(d), sum(sorted(d)[-3:]) / 3])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(toxicity.held_out("doc_id"))
    rows = queries.op9_toxicity(spark, sf).join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    clean = sum(r.predicted for r in rows if not r.toxic) / sum(not r.toxic for r in rows)
    ranked = sorted(rows, key=lambda r: r.score)
    ranks = [i for i, r in enumerate(ranked) if r.toxic]
    auc = (sum(ranks) - len(ranks) * (len(ranks) - 1) / 2) / (len(ranks) * (len(rows) - len(ranks)))
    assert right > 0.94 and clean < 0.02 and auc > 0.9, (right, clean, auc)


def plain_near_duplicates(docs, n=5, least=0.8):
    """Smallest id of each document's group, by the Jaccard likeness of all pairs of shingle sets."""
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    alike = lambda a, b: a == b or len(a & b) >= least * len(a | b) - 1e-9
    return components(docs, lambda a, b: alike(sets[a], sets[b]))


def test_near_duplicates_of_many_kinds(spark):
    """Likeness around the edge, chains, short texts beside empty ones, and a passage that many unlike texts share."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    passage = " ".join(word() for _ in range(40))
    texts = [""] * 3 + [" ".join(word() for _ in range(n)) for n in (1, 2, 4, 5, 6, 6, 8, 8) for _ in range(8)]
    texts += [f"{passage} {' '.join(word() for _ in range(20))}" for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(r.randrange(30, 120))]
        for _ in range(6):
            base = [word() if r.random() < r.choice((0.005, 0.02, 0.05)) else w for w in base]
            texts.append(" ".join(base))
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    want = plain_near_duplicates(docs)
    assert 40 < len(set(want.values())) < len(docs) - 20
    for most in (simhash.MOST, 128):
        assert {x.doc_id for x in simhash.keep_one(df, most=most).collect()} == set(want.values())


@pytest.mark.parametrize("part", [30, 500_000])
def test_alike_groups_in_parts(spark, part, monkeypatch):
    """Groups and keys that are dealt over pairs of parts give the same components."""
    monkeypatch.setattr(alike, "HOT", 5)
    r = random.Random(2)
    base = [sorted(r.sample(range(400), 12)) for _ in range(5)]
    sets = [sorted({x if r.random() > 0.08 else r.randrange(400) for x in r.choice(base)}) for _ in range(120)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "node long, s array<long>")
    got = {x.node: x.root for x in alike.alike_groups(df, 0.7, part=part).collect()}
    want = components(range(120), lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.7 * len(set(sets[a]) | set(sets[b])) - 1e-9)
    assert {i: got.get(i, i) for i in range(120)} == want


def test_pipeline_stages(spark, docs):
    """Each stage against a plain version, on its own input."""
    table = written(spark.read.parquet(f"{SF}/documents.parquet"), "docs")
    read = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out("doc_id"))
    scorer = toxicity.train(table, labels).scorer()
    out = written(stages["toxicity"](spark, table, SF), "a")
    assert read(out) == Counter(i for i, t in docs.items() if scorer.score(t) < corpus_pipeline.TOXIC)
    left = {i: docs[i] for i in read(out)}
    root = plain_near_duplicates(left)
    out = written(stages["near-duplicates"](spark, out, SF), "b")
    assert read(out) == Counter(i for i in left if root[i] == i)
    left = {i: docs[i] for i in read(out)}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    out = written(stages["decontamination"](spark, out, SF), "c")
    assert read(out) == Counter(left.keys() - {d for d, _ in plain_leaks(left, items)})
    taken = {r.doc_id: r.copies for r in mixing.mix(out).select("row.doc_id", "copies").collect()}
    out = written(stages["mixing"](spark, out, SF), "d")
    assert read(out) == Counter({i: n for i, n in taken.items() if n})
    done = stages["sharding"](spark, out, SF)
    assert read(done) == read(out) and {r.shard for r in done.select("shard").collect()} <= set(range(8))
