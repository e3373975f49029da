"""Stored answers of web sites: robots rules, sitemaps, and the scan that goes from them to items.

Answers are a table of what a fetcher brought: url, status, body (binary). A fetcher is any function from a
DataFrame of urls to such answers, so crawling itself stays outside.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import netloc, origin, strings, url_key, utf8
from ..operators.entities import Dictionary
from ..storage import written
from .readers import crawled, parsed_time

#: Paths that are tried where no sitemap is declared; fixed values.
WELL_KNOWN = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml"]
#: Media types of pages.
PAGE_TYPES = ("text/html", "text/plain")

Fetch = Callable[[DataFrame], DataFrame]


def robots_lines(answers: DataFrame) -> DataFrame:
    """(host, n, field, value) of the robots.txt answers (url, status, body): their lines in order.

    Comments and blank lines go. A null body or a status of 400 or more is a site without a robots file.
    """
    text = F.regexp_replace(utf8(F.col("body")), "^﻿", "")
    good = answers.filter(F.col("body").isNotNull() & (F.coalesce("status", F.lit(200)) < 400) & F.col("url").endswith("/robots.txt"))
    lines = good.select(netloc(F.col("url")).alias("host"), F.posexplode(F.split(text, r"\R")).alias("n", "line"))
    bare = lines.withColumn("line", F.btrim(F.regexp_replace("line", "#.*$", "")))
    parts = F.regexp_extract("line", r"^([A-Za-z-]+)\s*:\s*(.*)$", 1), F.regexp_extract("line", r"^([A-Za-z-]+)\s*:\s*(.*)$", 2)
    return bare.select("host", "n", F.lower(parts[0]).alias("field"), F.btrim(parts[1]).alias("value")).filter("field <> ''")


def robots_rules(answers: DataFrame, agent: str = "*") -> DataFrame:
    """(host, n, allow, prefix): the rules that hold for an agent, in order.

    A group is some user-agent lines and the rules up to the next of these after a rule. The groups that
    name the agent hold, else those for "*". An empty Disallow allows all.
    """
    rules = robots_lines(answers).filter(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("n")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = rules.withColumn("g", F.sum(starts.cast("int")).over(order)).filter("g > 0")
    names = grouped.filter("field = 'user-agent'").select("host", "g", F.lower("value").alias("agent"))
    own = names.filter(F.lit(agent.lower()).contains(F.col("agent")) & (F.col("agent") != "*")).select("host", "g")
    general = names.filter("agent = '*'").select("host", "g").join(own.select("host").distinct(), "host", "left_anti")
    held = grouped.filter("field <> 'user-agent'").join(own.unionByName(general).distinct(), ["host", "g"])
    path = F.regexp_replace("value", r"\*+$", "")
    return held.select("host", "n", ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"), F.when(F.col("value") == "", F.lit("/")).otherwise(path).alias("prefix"))


def declared_sitemaps(answers: DataFrame) -> DataFrame:
    """(host, n, url) of the Sitemap lines of robots.txt answers, in order."""
    return robots_lines(answers).filter("field = 'sitemap' AND value <> ''").select("host", "n", F.col("value").alias("url"))


def permitted(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages (url, ...) that the robots rules (host, n, allow, prefix) let an agent read.

    Of a host's rules that a path begins with the first one decides; without one the page may be read.
    """
    path = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"^(?=[?#]|$)", "/")
    p = pages.withColumns({"_host": netloc(F.col("url")), "_path": path})
    r = rules.select(F.col("host").alias("_h"), F.col("n").alias("_n"), F.col("allow").alias("_allow"), "prefix")
    urls = p.select("_host", "_path").distinct()
    first = urls.join(r, (F.col("_host") == F.col("_h")) & F.col("_path").startswith(F.col("prefix"))).groupBy("_host", "_path").agg(F.min_by("_allow", "_n").alias("_allow"))
    barred = first.filter("NOT _allow").select("_host", "_path")
    return p.join(barred, ["_host", "_path"], "left_anti").select(*pages.columns)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def parse_sitemap(url: str, data: bytes | None) -> list[tuple[str, str, str | None, str | None]]:
    """(kind, loc, lastmod, title) entries of a sitemap document, gzipped or not; none if it can't be read."""
    if data is None:
        return []
    try:
        if url.endswith(".gz") or data[:2] == b"\x1f\x8b":
            data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
        root = ElementTree.fromstring(data)
    except (OSError, EOFError, ElementTree.ParseError):
        return []
    index, out = _local(root.tag) == "sitemapindex", []
    for e in root.iter():
        if _local(e.tag) != ("sitemap" if index else "url"):
            continue
        own = {_local(c.tag): (c.text or "").strip() for c in e}
        title = next(((c.text or "").strip() for c in e.iter() if _local(c.tag) == "title"), None)
        if own.get("loc"):
            out.append(("sitemap" if index else "page", own["loc"], own.get("lastmod") or None, title or None))
    return out


def sitemap_entries(answers: DataFrame) -> DataFrame:
    """(sitemap, kind, loc, lastmod, title) of stored sitemap documents (url, status, body), XML or gzipped XML."""

    @F.pandas_udf("array<struct<kind:string,loc:string,lastmod:string,title:string>>")
    def entries(urls: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "loc", "lastmod", "title"), e, strict=True)) for e in parse_sitemap(u or "", b)] for u, b in zip(urls, bodies, strict=True)])

    good = answers.filter(F.coalesce("status", F.lit(200)) < 400)
    found = good.select(F.col("url").alias("sitemap"), F.explode(entries("url", "body")).alias("e"))
    return found.select("sitemap", "e.kind", "e.loc", parsed_time(F.col("e.lastmod")).alias("lastmod"), "e.title")


def sitemap_roots(sites: DataFrame, explicit: list[str], answers: DataFrame) -> DataFrame:
    """(n, url): the sitemaps to begin with, in order: explicit ones, then those that the robots files of the
    sites (n, url) declare, each once; if there are none, the well-known paths that hold a sitemap.

    A few rows per site, so they are put in order by one window.
    """
    spark = sites.sparkSession
    given = spark.createDataFrame([(0, 0, i, u) for i, u in enumerate(explicit)], "a int, b long, c int, url string")
    hosts = sites.select(F.col("n").cast("long").alias("b"), netloc(F.col("url")).alias("host"))
    said = declared_sitemaps(answers).join(hosts, "host").select(F.lit(1).alias("a"), "b", F.col("n").alias("c"), "url")
    both = given.unionByName(said)
    tried = sites.select(F.lit(2).alias("a"), F.col("n").cast("long").alias("b"), F.posexplode(F.transform(strings(WELL_KNOWN), lambda p: F.concat(origin(F.col("url")), p))).alias("c", "url"))
    head = F.lower(F.substring(utf8(F.col("body")), 1, 1000))
    there = answers.filter((F.coalesce("status", F.lit(200)) < 400) & (head.contains("<sitemapindex") | head.contains("<urlset"))).select("url").distinct()
    found = both if not both.isEmpty() else tried.join(there, "url").select("a", "b", "c", "url")
    once = found.groupBy("url").agg(F.min(F.struct("a", "b", "c")).alias("at"))
    return once.select((F.row_number().over(Window.orderBy("at")) - 1).alias("n"), "url")


def walk_sitemaps(entries: DataFrame, roots: list[str], max_depth: int = 3, include: str | None = None, exclude: str | None = None, after: datetime | None = None, max_pages: int | None = None, max_documents: int | None = None) -> DataFrame:
    """Pages (url, lastmod, title) reached from root sitemaps over stored entries (sitemap, loc, kind: sitemap or
    page, lastmod, and title if there is one).

    One join per level, at most ``max_depth`` below the roots, each written; sitemaps seen before are left out,
    so cycles end. Of the documents in order of (level, url) the first ``max_documents`` are read. Page urls
    pass the include and exclude patterns, case aside, and lastmod the time; undated ones stay.
    """
    spark = entries.sparkSession
    titled = entries if "title" in entries.columns else entries.withColumn("title", F.lit(None).cast("string"))
    e = titled.withColumns({"sitemap": url_key(F.col("sitemap")), "key": url_key(F.col("loc"))})
    level = spark.createDataFrame([(r,) for r in roots], "url string").select(url_key(F.col("url")).alias("url")).distinct()
    seen, pages, read = level, None, 0
    for _ in range(max_depth + 1):
        if max_documents is not None:
            level = level.orderBy("url").limit(max_documents - read)
        level = written(level, "sitemaps")
        read += level.count()
        found = e.join(level, F.col("sitemap") == F.col("url")).select("key", "loc", "kind", "lastmod", "title")
        own = written(found.filter("kind = 'page'"), "pages")
        pages = own if pages is None else pages.unionByName(own)
        seen = written(seen.unionByName(level).distinct(), "seen")
        level = found.filter("kind = 'sitemap'").select(F.col("key").alias("url")).distinct().join(seen, "url", "left_anti")
        if level.isEmpty() or (max_documents is not None and read >= max_documents):
            break
    pages = pages.groupBy("key").agg(F.min("loc").alias("url"), F.max("lastmod").alias("lastmod"), F.max("title").alias("title"))
    if include:
        pages = pages.filter(F.col("url").rlike(f"(?i){include}"))
    if exclude:
        pages = pages.filter(~F.col("url").rlike(f"(?i){exclude}"))
    if after is not None:
        pages = pages.filter(F.col("lastmod").isNull() | (F.col("lastmod") > F.lit(after)))
    pages = pages.select("url", "lastmod", "title").orderBy(F.desc("lastmod"), "url")
    return pages if max_pages is None else pages.limit(max_pages)


@dataclass(frozen=True)
class SiteOptions:
    """What a site source asks for."""

    sitemaps: list[str] = field(default_factory=list)
    include: str | None = None
    exclude: str | None = None
    max_pages: int | None = 500
    max_documents: int | None = 200
    max_depth: int = 3
    min_text_chars: int = 400
    dictionary: Dictionary | None = None
    keywords: list[str] | None = None
    min_matches: int = 1
    agent: str = "*"


def read_site(endpoints: list[str], fetch: Fetch, spark, options: SiteOptions | None = None, after: datetime | None = None) -> DataFrame:
    """Items of the sites at some endpoints: robots files, sitemaps, pages, text, filters.

    Pages must be on an endpoint's host and permitted, have a page's media type (where answers tell one), enough
    text and enough different matches. No sitemap at all is an error.
    """
    o = options or SiteOptions()
    sites = spark.createDataFrame(list(enumerate(endpoints)), "n int, url string")
    robots = sites.select(F.concat(origin(F.col("url")), F.lit("/robots.txt")).alias("url"))
    tried = sites.select(F.explode(F.transform(strings(WELL_KNOWN), lambda p: F.concat(origin(F.col("url")), p))).alias("url"))
    first = written(fetch(robots.unionByName(tried).distinct()), "robots")
    roots = [r.url for r in sitemap_roots(sites, o.sitemaps, first).orderBy("n").collect()]
    if not roots:
        raise ValueError(f"no sitemap found for {', '.join(endpoints)}")
    asked = spark.createDataFrame([(r,) for r in roots], "url string")
    entries, seen = None, asked
    for _ in range(o.max_depth + 1):
        new = written(sitemap_entries(fetch(asked)), "entries")
        entries = new if entries is None else entries.unionByName(new)
        asked = written(new.filter("kind = 'sitemap'").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"), "asked")
        if asked.isEmpty():
            break
        seen = seen.unionByName(asked)
    pages = walk_sitemaps(entries, roots, o.max_depth, o.include, o.exclude, after, o.max_pages, o.max_documents)
    hosts = sites.select(netloc(F.col("url")).alias("_site")).distinct()
    pages = permitted(pages.join(F.broadcast(hosts), netloc(F.col("url")) == F.col("_site"), "left_semi"), robots_rules(first, o.agent))
    answers = fetch(pages.select("url")).filter(F.coalesce("status", F.lit(200)) < 400)
    if "media_type" in answers.columns:
        answers = answers.filter(F.col("media_type").isin(*PAGE_TYPES))
    html = answers.select("url", utf8(F.col("body")).alias("html"))
    items = crawled(html, o.min_text_chars, o.dictionary, o.keywords, o.min_matches)
    dated = items.join(pages.select("url", "lastmod", F.col("title").alias("_title")), "url", "left")
    return dated.select("url", F.coalesce("title", "_title").alias("title"), "content", "media_type", F.coalesce("published_at", "lastmod").alias("published_at"))


def stored_answers(answers: DataFrame) -> Fetch:
    """A fetcher over a table of stored answers (url, status, body)."""
    return lambda urls: urls.select("url").distinct().join(answers, "url")
