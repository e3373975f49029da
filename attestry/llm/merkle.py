"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces (built-in functions only)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A section is lines up to blank ones, a paragraph a line; both hold the line feeds that end them.
SECTION, PARAGRAPH = r"[^\n]+(?:\n[^\n]+)*\n*|\n+", r"[^\n]+\n*|\n+"
#: SECTION as Java needs it: its groups take a stack frame for each line unless they give nothing back, and nothing is wanted back.
SECTION_KEPT = r"[^\n]+(?:\n[^\n]+)*+\n*|\n+"
#: A leaf is 16 to 64 characters of a paragraph and ends where the content says so: after one of some characters.
PIECE = r"(?s).{15,63}?[gpbvkzGPBVKZ.,;:!?0-9的。、，のはжы]|.{1,64}"
#: Hexadecimal digits of a leaf that the fingerprint keeps.
LEAF = 8
#: Ranges of doc_id at most: 64 x 64 x 64 bounds, literals of the expression.
RANGES = 1 << 18
LAST = (1 << 63) - 1


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def fingerprint(text: Column) -> Column:
    """The tree of a text as a string: ``root:leaves``.

    root is the SHA-256 of the sections' digests; a section's digest is the MD5 of its paragraphs'
    digests, a paragraph's that of its leaves'. Leaves follow by eight hexadecimal digits each, with
    "." between paragraphs and "/" between sections. Every character, line feeds too, is in one leaf, so
    equal roots mean equal texts. Leaves are cut by content: an insertion changes the leaves around it. In
    a paragraph without any of the characters that end leaves, they are cut every 64 characters and an
    insertion changes all that follow. Null is as empty: no leaves. A very long text is read whole and
    gives a string of about a third of its length. Equal texts, repeated rows too, have equal fingerprints.
    """

    def paragraph(p: Column) -> Column:
        leaves = F.transform(_parts(p, PIECE), lambda x: F.md5(x))
        return _let(leaves, lambda v: F.struct(F.md5(F.concat_ws("", v)).alias("d"), F.concat_ws("", F.transform(v, lambda x: F.substring(x, 1, LEAF))).alias("e")))

    def section(s: Column) -> Column:
        return _let(F.transform(_parts(s, PARAGRAPH), paragraph), lambda v: F.struct(F.md5(F.concat_ws("", v["d"])).alias("d"), F.concat_ws(".", v["e"]).alias("e")))

    sections = F.transform(_parts(F.coalesce(text, F.lit("")), SECTION_KEPT), section)
    return _let(sections, lambda v: F.concat(F.sha2(F.concat_ws("", v["d"]), 256), F.lit(":"), F.concat_ws("/", v["e"])))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are: 1 for equal roots, else twice the common leaves over all leaves (as sets)."""
    leaves = lambda f: F.array_distinct(F.regexp_extract_all(F.substring_index(f, ":", -1), F.lit("[0-9a-f]{%d}" % LEAF), F.lit(0)))
    dice = _let(F.struct(leaves(a).alias("a"), leaves(b).alias("b")), lambda v: 2.0 * F.size(F.array_intersect(v["a"], v["b"])) / F.greatest(F.size(v["a"]) + F.size(v["b"]), F.lit(1)))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(dice)


def differing(a: Column, b: Column) -> Column:
    """The branches that only one of two fingerprints has, as (side, section, paragraph), 0-based; none if
    roots are equal. Branches are told apart by their leaves and not by their place, so what follows an
    insertion is not named. A branch that one side repeats more often, or that moved, is not named either."""
    kind = "array<struct<side:string,section:int,paragraph:int>>"
    sections = lambda f: F.split(F.substring_index(f, ":", -1), "/")
    paragraphs = lambda f: F.split(F.substring_index(f, ":", -1), "[/.]")

    def only(x: Column, other: Column, side: str) -> Column:
        inside = lambda s, i: F.filter(F.transform(F.split(s, r"\."), lambda p, j: F.struct(F.lit(side).alias("side"), i.alias("section"), j.alias("paragraph"), p.alias("p"))), lambda z: (z["p"] != "") & ~F.array_contains(other, z["p"]))
        return F.transform(F.flatten(F.transform(sections(x), inside)), lambda z: F.struct(z["side"].alias("side"), z["section"].alias("section"), z["paragraph"].alias("paragraph")))

    found = _let(F.struct(paragraphs(a).alias("a"), paragraphs(b).alias("b")), lambda v: F.concat(only(a, v["b"], "a"), only(b, v["a"], "b")))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast(kind)).otherwise(found.cast(kind))


def _count_upto(bounds: list[int], x: Column) -> Column:
    """How many of the sorted bounds are x or less, by three looks at 64 literals or fewer."""
    if not bounds:
        return F.lit(0)
    longs = lambda v: f"cast(array({', '.join(f'{b}L' for b in v)}) as array<bigint>)"
    below = lambda v, x: F.size(F.filter(v, lambda b: b <= x))
    blocks = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    tops = [b[0] for b in blocks]
    groups = [tops[i : i + 64] for i in range(0, len(tops), 64)]
    i = below(F.expr(longs([g[0] for g in groups])), x)
    nested = lambda v: F.expr("array(" + ", ".join(longs(z) for z in v) + ")")
    j = _let(i, lambda i: F.when(i > 0, (i - 1) * 64 + below(F.element_at(nested(groups), F.greatest(i, F.lit(1))), x)).otherwise(0))
    return _let(j, lambda j: F.when(j > 0, (j - 1) * 64 + below(F.element_at(nested(blocks), F.greatest(j, F.lit(1))), x)).otherwise(0)).cast("long")


def _ranges(ids: DataFrame, n: int) -> Column:
    """The range of (d, tie) that a row is in, ascending: about n of near equal numbers of rows. An id that
    holds several ranges' rows is split by its tie."""
    found = ids.agg(F.percentile_approx("d", [i / n for i in range(1, n)], max(20_000, 8 * n))).first()[0] if n > 1 else None
    times = Counter(found or [])
    hot = {v: k for v, k in times.items() if k > 1}
    bounds = sorted(set(times) | {v + 1 for v in hot if v < LAST})
    at = _count_upto(bounds, F.col("d")) * (1 << 20)
    if not hot:
        return at
    place = F.shiftright(F.col("tie"), 32) + (1 << 31)
    parts = F.coalesce(F.element_at(F.map_from_arrays(F.expr(f"array({', '.join(f'{v}L' for v in hot)})"), F.expr(f"array({', '.join(f'{k}L' for k in hot.values())})")), F.col("d")), F.lit(1))
    return at + F.floor(place * parts / float(1 << 32)).cast("long")


def with_next(docs: DataFrame, range_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, text, fingerprint of each row of docs (doc_id, text), and next_text, next_fingerprint of the
    row that follows by ascending doc_id (nulls last, ties by a hash of the text), the first after the last.

    Rows are dealt by ranges of (doc_id, hash of the text) of about ``range_bytes``; only the last row of a
    range needs the first of the next one, which a join by range brings. Texts are shuffled once. Null text
    is empty; rows with equal id and text follow each other and stay in one range; a single row follows
    itself; empty input: no rows. A very long text takes part whole.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"))
    base = base.withColumn("bin", _ranges(ids, min(RANGES, max(1, size // range_bytes))))
    firsts = base.groupBy("bin").agg(F.min(F.struct("d", "tie")).alias("f")).orderBy("bin").collect()
    in_order = Window.partitionBy("bin").orderBy("d", "tie")
    rows = base.withColumn("_next", F.lead(F.struct("text")).over(in_order)).withColumn("fingerprint", fingerprint(F.col("text")))
    rows = rows.withColumn("_next_print", F.lead("fingerprint").over(in_order))
    # one row per range
    for_bin = docs.sparkSession.createDataFrame([(firsts[i - 1].bin, r.f.d, r.f.tie) for i, r in enumerate(firsts)], "for_bin long, d long, tie long")
    heads = base.join(F.broadcast(for_bin), ["d", "tie"]).groupBy("for_bin").agg(F.min("text").alias("head"))
    rows = rows.join(heads.withColumnRenamed("for_bin", "bin"), "bin", "left")
    last = F.col("_next").isNull()
    return rows.select("doc_id", "text", "fingerprint", F.when(last, F.col("head")).otherwise(F.col("_next.text")).alias("next_text"), F.when(last, fingerprint(F.col("head"))).otherwise(F.col("_next_print")).alias("next_fingerprint"))
