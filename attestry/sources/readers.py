"""Connectors over stored feeds, folders and crawls. Items: url, title, content, media_type, published_at."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_path, page_published, page_title, strip_html, utf8
from ..operators.entities import Dictionary, relevant

#: Media types by file suffix; fixed values.
MEDIA_TYPES = {".md": "text/markdown", ".txt": "text/plain", ".html": "text/html", ".htm": "text/html", ".pdf": "application/pdf", ".json": "application/json", ".csv": "text/csv"}


def parsed_time(c: Column) -> Column:
    """Feed dates: RFC 822 or ISO 8601; null if neither."""
    bare = F.regexp_replace(c, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(bare, " GMT$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c))


def since(items: DataFrame, at: datetime | None) -> DataFrame:
    """Items published later than a time, and undated ones."""
    return items if at is None else items.filter(F.col("published_at").isNull() | (F.col("published_at") > F.lit(at)))


def read_feed(spark: SparkSession, path: str, after: datetime | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Items of stored RSS feeds and entries of Atom feeds: the content, else the summary, else the title is the body.

    With ``fetch`` (urls to url, html; robots are its affair) the text of the full page stands for the body
    wherever it brings one.
    """
    rss = "title string, link string, description string, pubDate string, `content:encoded` string"
    raw = spark.read.format("xml").option("rowTag", "item").schema(rss).load(path)
    body = F.coalesce(F.col("`content:encoded`"), "description", "title", F.lit(""))
    items = raw.select(F.col("link").alias("url"), "title", body.alias("content"), parsed_time(F.col("pubDate")).alias("published_at"))
    link = "struct<_href:string,_rel:string>"
    worded = "struct<_VALUE:string,_type:string>"
    atom = f"title {worded}, link array<{link}>, summary {worded}, content {worded}, published string, updated string, id string"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(atom).load(path)
    own = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    url = F.coalesce(F.get(own, F.lit(0))["_href"], F.get("link", F.lit(0))["_href"], "id")
    body = F.coalesce("content._VALUE", "summary._VALUE", "title._VALUE", F.lit(""))
    entries = raw.select(url.alias("url"), F.col("title._VALUE").alias("title"), body.alias("content"), parsed_time(F.coalesce("published", "updated")).alias("published_at"))
    items = items.unionByName(entries)
    if fetch is not None:
        pages = fetch(items.select("url").distinct()).select("url", strip_html(F.col("html")).alias("_full")).filter("_full <> ''")
        items = items.join(pages, "url", "left").withColumn("content", F.coalesce("_full", "content")).drop("_full")
    return since(items.select("url", "title", "content", F.lit("text/html").alias("media_type"), "published_at"), after)


def read_json(spark: SparkSession, path: str, items_path: str, fields: dict[str, str], after: datetime | None = None) -> DataFrame:
    """Items of stored JSON answers, one document per file. ``fields`` maps url, title, published_at and content
    to dotted paths; without content the whole item is the body. A path that holds no list is an error."""
    docs = spark.read.text(path, wholetext=True).select(json_path(F.col("value"), items_path).alias("j"))
    listed = F.when(F.coalesce(F.col("j"), F.lit("")).startswith("["), F.from_json("j", "array<string>"))
    items = docs.select(F.explode(F.coalesce(listed, F.raise_error(F.lit(f"items_path {items_path} holds no list")).cast("array<string>"))).alias("j"))
    at = lambda k: json_path(F.col("j"), fields[k]) if k in fields else F.lit(None).cast("string")
    kind = F.when(at("content").isNull(), "application/json").otherwise("text/plain")
    return since(items.select(at("url").alias("url"), at("title").alias("title"), F.coalesce(at("content"), "j").alias("content"), kind.alias("media_type"), parsed_time(at("published_at")).alias("published_at")), after)


def read_folder(spark: SparkSession, path: str, after: datetime | None = None) -> DataFrame:
    """Files below a folder but for hidden ones; the content is binary, the modification time the date."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if after is not None:
        reader = reader.option("modifiedAfter", after.strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.load(path)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), suffix), F.lit("application/octet-stream"))
    shown = files.filter(~F.col("path").rlike(r"/\.[^/]"))
    return shown.select(F.col("path").alias("url"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("title"), "content", kind.alias("media_type"), F.col("modificationTime").alias("published_at"))


def indent_json(text: str | None) -> str | None:
    """A JSON document, parsed and written with an indent of one; null if it is none."""
    try:
        return json.dumps(json.loads(text), indent=1, ensure_ascii=False) if text is not None else None
    except ValueError:
        return None


def indented_json(documents: Column) -> Column:
    @F.pandas_udf("string")
    def indented(batch: pd.Series) -> pd.Series:
        return pd.Series([indent_json(t) for t in batch], dtype=object)

    return indented(documents)


def extract_text(items: DataFrame, pdf: Callable[[Column], Column] | None = None, readable: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add text (trimmed) and extraction_status by media type: ok, empty, unsupported or failed.

    HTML goes through ``readable`` if there is one and is stripped of its tags where that finds nothing; JSON is
    parsed and indented, bad JSON has failed. A PDF needs an extractor: null has failed, less than 20
    characters are empty. Null content is empty.
    """
    raw = utf8(F.col("content"))
    kind, blank = F.col("media_type"), F.lit(" \t\n\r\f\x0b")
    page = strip_html(raw)
    if readable is not None:
        page = F.coalesce(F.nullif(F.btrim(readable(raw), blank), F.lit("")), page)
    plain = kind.isin("text/plain", "text/markdown", "text/csv")
    text = F.when(kind == "text/html", page).when(plain, F.btrim(raw, blank)).when(kind == "application/json", indented_json(raw))
    if pdf is not None:
        text = F.when(kind == "application/pdf", F.btrim(pdf(F.col("content")), blank)).otherwise(text)
    known = plain | kind.isin("text/html", "application/json") | F.lit(pdf is not None) & (kind == "application/pdf")
    short = (F.col("text") == "") | (kind == "application/pdf") & (F.length("text") < 20)
    status = F.when(~F.coalesce(known, F.lit(False)), "unsupported").when(F.col("content").isNull(), "empty").when(F.col("text").isNull(), "failed").when(short, "empty").otherwise("ok")
    done = items.withColumn("text", text)
    return done.withColumn("extraction_status", status).withColumn("text", F.when(F.col("extraction_status") == "ok", F.col("text")).otherwise(""))


def published(items: DataFrame) -> DataFrame:
    """Fill published_at with fetched_at where it is null, and add published_ts in whole seconds."""
    return items.withColumn("published_at", F.coalesce("published_at", "fetched_at")).withColumn("published_ts", F.unix_timestamp("published_at"))


def crawled(pages: DataFrame, min_chars: int = 400, dictionary: Dictionary | None = None, keywords: list[str] | None = None, min_matches: int = 1) -> DataFrame:
    """Items of stored pages (url, html) that are long enough and, given entities or keywords, relevant."""
    items = pages.select("url", page_title(F.col("html")).alias("title"), strip_html(F.col("html")).alias("content"), F.lit("text/plain").alias("media_type"), page_published(F.col("html")).alias("published_at")).filter(F.length("content") >= min_chars)
    if dictionary is not None or keywords:
        items = items.filter(relevant(F.concat_ws(" ", "title", "content"), dictionary or Dictionary([]), keywords, min_matches))
    return items


def _by_url(name: str) -> Callable[..., DataFrame]:
    """An adapter over stored answers; its module needs this one."""

    def read(spark: SparkSession, endpoint: str, after: datetime | None = None, **options) -> DataFrame:
        from . import answers

        return getattr(answers, name)(spark, endpoint, after=after, **options)

    return read


ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "rss": read_feed, "http_api": read_json, "local_folder": read_folder, "feed": _by_url("feed_items"), "site": _by_url("site_items"),
}


def adapter(name: str) -> Callable[..., DataFrame]:
    if name not in ADAPTERS:
        raise ValueError(f"unknown adapter {name!r}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]
