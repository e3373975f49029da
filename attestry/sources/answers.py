"""Stored answers of web servers, as Python data sources: ``spark.read.format("feed")`` and ``format("site")``.

Answers are a Parquet folder (url, status, body, fetched_at, and etag, last_modified where known) that fetchers append to.
Each endpoint is a partition of its own. As a stream, a feed's offsets are the high-water marks of its endpoints.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from urllib.parse import urldefrag, urlsplit
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import crawled, since
from .sites import WELL_KNOWN, SiteOptions, parse_sitemap

ITEMS = "endpoint string, url string, title string, content string, media_type string, published_at timestamp"
PAGES = "endpoint string, url string, title string, html string, lastmod timestamp"
#: The session's setting that names the folder of answers.
FOLDER = "spark.attestry.answers"
#: Pages of a site that are read at once.
PAGES_AT_ONCE = 500


def parsed_date(value: str | None) -> datetime | None:
    """A feed's date in UTC without a zone; None if it is neither RFC 822 nor ISO 8601."""
    if not value:
        return None
    for parse in (parsedate_to_datetime, lambda v: datetime.fromisoformat(v.strip())):
        try:
            at = parse(value)
            return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
        except (ValueError, TypeError, IndexError):
            pass
    return None


def _text(e: ElementTree.Element, *names: str) -> str | None:
    """The first non-empty text of a child by its local name."""
    for name in names:
        for c in e:
            if c.tag.rsplit("}", 1)[-1].lower() == name and (found := "".join(c.itertext()).strip()):
                return found
    return None


def feed_entries(body: bytes | None) -> list[tuple[str | None, str | None, str, datetime | None]]:
    """(url, title, content, published_at) of an RSS or Atom document: the content, else the summary, else the title is
    the body. A document that can't be parsed is an error."""
    out = []
    for e in ElementTree.fromstring(body or b"<rss/>").iter():
        kind = e.tag.rsplit("}", 1)[-1].lower()
        if kind not in ("item", "entry"):
            continue
        title = _text(e, "title")
        links = [c for c in e if c.tag.rsplit("}", 1)[-1].lower() == "link"]
        own = [c.get("href") for c in links if c.get("href") and c.get("rel", "alternate") == "alternate"] or [c.get("href") for c in links if c.get("href")]
        url = own[0] if own else _text(e, "link", "id", "guid")
        content = _text(e, "encoded", "content", "description", "summary") or title or ""
        out.append((url, title, content, parsed_date(_text(e, "pubdate", "published", "updated"))))
    return out


def _files(folder: str):
    """The answers' files as a dataset."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder if re.match(r"[a-z0-9]+:", folder) else f"file://{folder}"))
    return ds.dataset(path, filesystem=store, format="parquet", exclude_invalid_files=True)


def _table(folder: str, urls: list[str] | None, columns: list[str], files=None) -> list[dict]:
    """Rows of the answers to some urls, by fetched_at; the filter is pushed to the files. Of files in the order of urls only the
    row groups between the least and the greatest url are read."""
    import pyarrow.dataset as ds

    url = ds.field("url")
    wanted = (url >= min(urls)) & (url <= max(urls)) & url.isin(urls) if urls else None if urls is None else url.isin(urls)
    rows = (files or _files(folder)).to_table(columns=columns, filter=wanted).to_pylist()
    for r in rows:
        if r["fetched_at"].tzinfo:
            r["fetched_at"] = r["fetched_at"].astimezone(UTC).replace(tzinfo=None)
    return sorted(rows, key=lambda r: r["fetched_at"])


def _good(row: dict) -> bool:
    return (row["status"] or 200) < 400 and row["status"] != 304


def _ms(at: datetime) -> int:
    return round(at.replace(tzinfo=UTC).timestamp() * 1000)


def _at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


@dataclass
class Endpoint(InputPartition):
    """The answers of one endpoint that came after one time and not after another (ms); of a site, one part of its pages."""

    url: str
    after: int = -1
    upto: int = 1 << 62
    part: int = 0
    parts: int = 1


class _Asked:
    """What the options say: endpoints (a JSON list), answers (a folder), since (ISO 8601)."""

    def __init__(self, options: dict):
        self.folder, self.endpoints = options["answers"], json.loads(options["endpoints"])
        self.since = datetime.fromisoformat(options["since"]) if options.get("since") else None
        self.options = dict(options)


class FeedReader(_Asked, DataSourceReader):
    def partitions(self) -> list[Endpoint]:
        return [Endpoint(u) for u in self.endpoints]

    def read(self, partition: Endpoint) -> Iterator[tuple]:
        """Items of the latest answer that is no failure and no 304."""
        rows = [r for r in _table(self.folder, [partition.url], ["url", "status", "body", "fetched_at"]) if _good(r)]
        for url, title, content, at in feed_entries(rows[-1]["body"]) if rows else []:
            if self.since is None or at is None or at > self.since:
                yield partition.url, url, title, content, "text/html", at


class FeedStream(_Asked, DataSourceStreamReader):
    """Offsets are each endpoint's high-water mark: when its latest good answer came. An endpoint that fails keeps its own."""

    def initialOffset(self) -> dict:
        return {u: -1 for u in self.endpoints}

    def latestOffset(self) -> dict:
        marks = self.initialOffset()
        for r in _table(self.folder, self.endpoints, ["url", "status", "fetched_at"]):
            if (r["status"] or 200) < 400:
                marks[r["url"]] = max(marks[r["url"]], _ms(r["fetched_at"]))
        return marks

    def partitions(self, start: dict, end: dict) -> list[Endpoint]:
        return [Endpoint(u, start.get(u, -1), end[u]) for u in end if end[u] > start.get(u, -1)]

    def read(self, partition: Endpoint) -> Iterator[tuple]:
        """Items of the interval's answers that were published after the mark before each answer, and undated ones."""
        mark = partition.after
        for r in _table(self.folder, [partition.url], ["url", "status", "body", "fetched_at"]):
            at_ms = _ms(r["fetched_at"])
            if not partition.after < at_ms <= partition.upto or not _good(r):
                continue
            for url, title, content, at in feed_entries(r["body"]):
                if mark < 0 or at is None or at > _at(mark):
                    yield partition.url, url, title, content, "text/html", at
            mark = at_ms

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    """RSS and Atom feeds over stored answers, in batches and as a stream."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(self.options)


class SiteReader(_Asked, DataSourceReader):
    """One partition per site, or as many as the option ``parts`` (a JSON object) says: robots file, sitemaps, permitted pages or
    a part of them. Text is taken out by Spark afterwards."""

    def partitions(self) -> list[Endpoint]:
        parts = json.loads(self.options.get("parts", "{}"))
        return [Endpoint(u, part=i, parts=parts.get(u, 1)) for u in self.endpoints for i in range(parts.get(u, 1))]

    def _latest(self, urls: list[str], files=None) -> dict[str, dict]:
        rows = _table(self.folder, urls, ["url", "status", "body", "fetched_at"], files)
        return {r["url"]: r for r in rows if _good(r) and r["body"] is not None}

    def read(self, partition: Endpoint) -> Iterator[tuple]:
        o = json.loads(self.options.get("site", "{}"))
        parts = urlsplit(partition.url)
        origin = f"{parts.scheme}://{parts.netloc}"
        files = _files(self.folder)
        first = self._latest([f"{origin}/robots.txt", *(origin + p for p in WELL_KNOWN)], files)
        rules = RobotFileParser()
        said = first[f"{origin}/robots.txt"]["body"].decode("utf-8", "replace").lstrip("﻿").splitlines() if f"{origin}/robots.txt" in first else []
        rules.parse(said)
        roots = list(dict.fromkeys([*o.get("sitemaps", []), *(rules.site_maps() or [])])) or [u for u in first if u.endswith(".xml")]
        if not roots:
            raise ValueError(f"no sitemap found for {partition.url}")
        pages, level, seen = {}, roots, set()
        for _ in range(o.get("max_depth", 3) + 1):
            level = [u for u in dict.fromkeys(level) if urldefrag(u)[0].rstrip("/") not in seen]
            level = level if o.get("max_documents") is None else level[: max(0, o["max_documents"] - len(seen))]
            seen |= {urldefrag(u)[0].rstrip("/") for u in level}
            found = [e for u, r in self._latest(level, files).items() for e in parse_sitemap(u, r["body"])] if level else []
            for kind, loc, lastmod, title in found:
                if kind == "page":
                    pages.setdefault(urldefrag(loc)[0].rstrip("/"), (loc, parsed_date(lastmod), title))
            level = [loc for kind, loc, _, _ in found if kind == "sitemap"]
        keep = [
            p for p in pages.values()
            if urlsplit(p[0]).netloc == parts.netloc and rules.can_fetch(o.get("agent", "*"), p[0])
            and (not o.get("include") or re.search(o["include"], p[0], re.I)) and not (o.get("exclude") and re.search(o["exclude"], p[0], re.I))
            and (self.since is None or p[1] is None or p[1] > self.since)
        ]
        keep.sort(key=lambda p: (p[1] is None, -_ms(p[1]) if p[1] else 0, p[0]))
        keep = keep[: o["max_pages"]] if o.get("max_pages") is not None else keep
        keep = keep[len(keep) * partition.part // partition.parts : len(keep) * (partition.part + 1) // partition.parts]
        for at in range(0, len(keep), PAGES_AT_ONCE):
            some = keep[at : at + PAGES_AT_ONCE]
            bodies = self._latest([p[0] for p in some], files)
            for url, lastmod, title in some:
                if url in bodies:
                    yield partition.url, url, title, bodies[url]["body"].decode("utf-8", "replace"), lastmod


class SiteSource(DataSource):
    """Pages of sites over stored answers."""

    @classmethod
    def name(cls) -> str:
        return "site"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> SiteReader:
        return SiteReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats "feed" and "site" known to a session."""
    for source in (FeedSource, SiteSource):
        spark.dataSource.register(source)
    return spark


def asked(reader, endpoints: list[str], answers: str, after: datetime | None = None, site: dict | None = None, parts: dict[str, int] | None = None):
    """A reader (of a batch or a stream) with the options of the formats; parts: tasks of a site, 1 where it says nothing."""
    reader = reader.option("endpoints", json.dumps(endpoints)).option("answers", answers)
    reader = reader.option("since", after.isoformat()) if after else reader
    reader = reader.option("parts", json.dumps(parts)) if parts else reader
    return reader.option("site", json.dumps(site)) if site else reader


def _folder(spark: SparkSession, answers: str | None) -> str:
    found = answers or spark.conf.get(FOLDER, None)
    if not found:
        raise ValueError(f"where are the answers? Set {FOLDER} to their folder")
    return found


def feed_items(spark: SparkSession, endpoint: str, after: datetime | None = None, answers: str | None = None) -> DataFrame:
    """The adapter of feeds by their url: items of the latest stored answer."""
    return asked(register(spark).read.format("feed"), [endpoint], _folder(spark, answers), after).load().drop("endpoint")


def site_items(spark: SparkSession, endpoint: str, after: datetime | None = None, answers: str | None = None, options: SiteOptions | None = None) -> DataFrame:
    """The adapter of sites: pages by the format "site", then their text and the relevance filters as read_site() has them."""
    o = options or SiteOptions()
    site = {k: getattr(o, k) for k in ("sitemaps", "include", "exclude", "max_pages", "max_documents", "max_depth", "agent")}
    pages = asked(register(spark).read.format("site"), [endpoint], _folder(spark, answers), after, site).load()
    items = crawled(pages.select("url", "html"), o.min_text_chars, o.dictionary, o.keywords, o.min_matches)
    dated = items.join(pages.select("url", "lastmod", F.col("title").alias("_title")), "url")
    out = dated.select("url", F.coalesce("title", "_title").alias("title"), "content", "media_type", F.coalesce("published_at", "lastmod").alias("published_at"))
    return since(out, after)

