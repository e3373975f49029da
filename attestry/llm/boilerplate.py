"""Line dedup by site-relative frequency (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|td|th|main|aside|form|blockquote|pre|body|head|html)\b[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: Most boilerplate lines that are sent to every executor; beyond it they are joined by host, and hosts of over
#: PART pages are split into so many parts, of which each has the lines.
BROADCAST_LINES, PART = 200_000, 50_000


def page_lines(html: Column) -> Column:
    """The visible lines of a page, in order: block tags end a line, white space is collapsed, empty lines go."""
    text = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), "\n", " "), HIDDEN, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), "<[^>]*>", "")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x09\x0B-\x0D\x20]+", " ")))
    return F.filter(lines, lambda x: x != "")


def page_host(url: Column) -> Column:
    """Lower-case host of a URL; empty if it has none or is null."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def strip_boilerplate(pages: DataFrame, ratio: float = 0.1, least_pages: int = 3) -> DataFrame:
    """Drop from each row of pages (url, html) the lines that more than ``ratio`` of its host's pages
    contain, if ``least_pages`` of them do at least.

    A page counts once for a line, however often it repeats it; repeated rows are pages of their own.
    Pages without a host keep all lines; null html has none. Lines are compared by MD5 of the whole
    line. Pages are taken apart once and written. Counts are summed by (host, line) with partial
    aggregation, so a large host is spread over all tasks; a host has at most (lines a page / ratio) such
    lines, which go back to its pages: by broadcast if they are few, else by a join on host and part.
    Very long lines are compared and kept whole. Empty input: no rows.

    Returns ``row`` (the input row without html, as a struct), host, lines, kept (arrays of strings).
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "html"])
    rows = written(pages.select(rest.alias("row"), page_host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines")), "lines")
    sited = rows.filter("host <> ''")
    seen = sited.select("host", F.explode(F.array_distinct(F.transform("lines", _digest))).alias("line")).groupBy("host", "line").count()
    totals = written(sited.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_LINES else totals
    often = seen.filter(F.col("count") >= least_pages).join(totals, "host").filter(F.col("count") > F.col("pages") * ratio)
    drop = written(often.groupBy("host").agg(F.collect_set("line").alias("_drop")), "boilerplate")
    few = (drop.agg(F.sum(F.size("_drop") + 1)).first()[0] or 0) <= BROADCAST_LINES
    kept = F.when(F.col("_drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("_drop", _digest(x))))
    if few:
        return rows.join(F.broadcast(drop), "host", "left").select("row", "host", "lines", kept.alias("kept"))
    # one row for each host of many pages
    large = written(totals.filter(F.col("pages") > PART).select("host", F.ceil(F.col("pages") / PART).cast("int").alias("_parts")), "large-hosts")
    large = F.broadcast(large) if large.count() <= BROADCAST_LINES else large
    parts = F.coalesce("_parts", F.lit(1))
    dealt = sited.join(large, "host", "left").withColumn("_part", F.pmod(F.xxhash64(F.to_json("row")), parts))
    lines = drop.join(large, "host", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).select("host", F.col("_part").cast("long").alias("_part"), "_drop")
    out = dealt.join(lines, ["host", "_part"], "left").select("row", "host", "lines", kept.alias("kept"))
    return out.unionByName(rows.filter("host = ''").select("row", "host", "lines", F.col("lines").alias("kept")))
