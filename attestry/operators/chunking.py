"""Recursive chunks as one expression: coarse separators first, small pieces put together again with an overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators, coarse to fine; fixed values. Where none of them is left, a piece is cut between characters.
SEPARATORS = ("\n\n", "\n", " ")
SIZE, OVERLAP = 1600, 200
#: White space that is taken off both ends of a chunk.
BLANK = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Kinds of items: a piece shorter than a chunk, one that is to be split further, the end of a run, a chunk as it is.
PIECE, LONG, END, CHUNK = 0, 1, 2, 3

ITEM = "struct<kind:int,text:string>"
STATE = "struct<chunks:array<string>,held:array<struct<text:string,before:int>>,upto:int>"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def _item(kind: int | Column, text: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(kind.alias("kind"), text.alias("text")).cast(ITEM)


def _parts(text: Column, separator: str) -> Column:
    """Pieces of a text, each beginning with the separator but for the first; none is empty."""
    found = F.split(text, "\\Q" + separator + "\\E", -1)
    return F.filter(F.transform(found, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p))), lambda p: p != "")


def _splitter(separator: str, size: int) -> Callable[[Column], Column]:
    """An item's items after a split at the separator."""
    end = F.array(_item(END, F.lit("")))

    def split(x: Column) -> Column:
        inner = F.transform(_parts(x["text"], separator), lambda p: _item(F.when(F.length(p) >= size, LONG).otherwise(PIECE), p))
        return F.when((x["kind"] == LONG) & F.contains(x["text"], F.lit(separator)), F.concat(end, inner, end)).otherwise(F.array(x))

    return split


def pieces(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Items (kind, text) of a text: at each separator in turn what is still too long is split, if it holds that separator.

    Pieces of one split that follow each other are a run; a run ends where a longer piece was split further. What is too
    long and holds no separator becomes chunks of ``size`` characters that overlap.
    """
    end = F.array(_item(END, F.lit("")))
    items = F.array(_item(LONG, text))
    for separator in SEPARATORS:
        items = F.flatten(F.transform(items, _splitter(separator, size)))

    def cut(x: Column) -> Column:
        step = size - overlap
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(x["text"]) - size) / step).cast("int")))
        whole = F.transform(starts, lambda i: _item(CHUNK, F.substring(x["text"], i * step + 1, F.lit(size))))
        return F.when(x["kind"] == LONG, F.concat(end, whole, end)).otherwise(F.array(x))

    return F.concat(F.flatten(F.transform(items, cut)), end)


def _fold(state: Column, x: Column, size: int, overlap: int) -> Column:
    """One item more: pieces are held until the next one doesn't fit; then they are a chunk, and as many of the last ones
    stay held as the overlap has room for and the next one leaves room for."""
    n, held, upto = F.length(x["text"]), state["held"], state["upto"]
    empty = F.array().cast("array<struct<text:string,before:int>>")
    joined = F.array_join(F.transform(held, lambda h: h["text"]), "")
    flushed = F.when(F.size(held) > 0, F.concat(state["chunks"], F.array(stripped(joined)))).otherwise(state["chunks"])
    own = F.array(F.struct(x["text"].alias("text"), upto.alias("before")))
    full = (F.size(held) > 0) & (upto - F.element_at(held, 1)["before"] + n > size)
    room = F.least(F.lit(overlap), size - n)
    kept = F.filter(held, lambda h: upto - h["before"] <= room)
    made = lambda chunks, held, upto: F.struct(chunks.alias("chunks"), held.alias("held"), upto.alias("upto")).cast(STATE)
    return (
        F.when(x["kind"] == END, made(flushed, empty, F.lit(0)))
        .when(x["kind"] == CHUNK, made(F.concat(state["chunks"], F.array(stripped(x["text"]))), empty, F.lit(0)))
        .when(full, made(flushed, F.concat(kept, own), upto + n))
        .otherwise(made(state["chunks"], F.concat(held, own), upto + n))
    )


def recursive_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of a text as an array of strings of ``size`` characters at most, without white space at their ends.

    Null text is empty; a text without anything but white space is one chunk as it stands.
    """
    whole = F.coalesce(text, F.lit(""))
    zero = F.struct(F.array().cast("array<string>").alias("chunks"), F.array().cast("array<struct<text:string,before:int>>").alias("held"), F.lit(0).alias("upto")).cast(STATE)

    def of(t: Column) -> Column:
        folded = F.aggregate(pieces(t, size, overlap), zero, lambda s, x: _fold(s, x, size, overlap), lambda s: s["chunks"])
        some = F.when(F.length(t) <= size, F.array(stripped(t))).otherwise(folded)
        return F.filter(some, lambda c: c != "")

    found = F.element_at(F.transform(F.array(whole), of), 1)
    return F.element_at(F.transform(F.array(found), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(whole))), 1)
