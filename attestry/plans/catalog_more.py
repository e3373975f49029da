"""More queries over the generated tables: searches, streams, stored answers, logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import block_max, chunking, corroborate, governance, index, ivf, near_duplicates, snapshots, substrings, verify
from ..operators.component_index import ComponentIndex
from ..operators.retrieve import dense_topk
from ..sources import answers, conditional
from ..storage import work_path, written
from ..streaming import bands, streaks
from . import tables
from .catalog import POLICY, _claims, _quantities, _texts, candidates_propose
from .tables import table


def benchmark_hits(spark: SparkSession, d: str) -> DataFrame:
    """Which documents hold which benchmark item, word for word, case aside."""
    low = lambda name, i: table(spark, d, name).select(F.col(i).alias("id"), F.lit("all").alias("key"), F.lower("text").alias("text"))
    found = substrings.occurrences(low("benchmark", "item_id"), low("documents", "doc_id"))
    return found.select(F.col("needle_id").alias("item_id"), F.col("text_id").alias("doc_id"))


def chunks_recursive(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.recursive_chunks(F.col("text"))).alias("n", "chunk"))
    return c.select("doc_id", "n", "chunk")


def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """An inverted file of all embeddings, calibrated on queries of its own; ids divisible by 20 are searched in it, and
    held against the exact search."""
    v = written(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").filter("embedding IS NOT NULL").withColumnRenamed("embedding", "vector"), "vectors")
    ask = lambda n: v.filter(F.col("id") % n == 0).withColumnRenamed("id", "query_id")
    sample = v.orderBy(F.xxhash64("id")).limit(200).withColumnRenamed("id", "query_id")
    file = ivf.calibrated(ivf.build(v), v, sample, 10)
    found, exact = written(ivf.search(file, ask(20), 10), "found"), written(dense_topk(ask(20), v, 10), "exact")
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("_f")), ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.avg(F.coalesce("_f", F.lit(0))) >= 0.9).alias("reached"))


def stream_signature_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Documents an hour apart as a stream: each text's cluster by links over 14 days at most, named by its earliest text."""
    raw = table(spark, d, "documents")
    made = lambda df: df.select(F.sha2("text", 256).alias("content_hash"), "text", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("created_at"))
    path = work_path(spark, "bands")
    stream = made(spark.readStream.schema(raw.schema).parquet(f"{d}/document[s].parquet").filter("text IS NOT NULL"))
    # rows of a table come in no order, so none is late
    bands.link_stream(stream, f"{path}/links", f"{path}/checkpoint", late="36500 days")
    docs = made(raw.filter("text IS NOT NULL")).withColumn("doc_id", F.lit(None))
    named = bands.clusters(docs.select("content_hash", "created_at"), f"{path}/links")
    ids = raw.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("id"))
    own = ids.select("id", F.substring("content_hash", 1, 16).alias("cluster_id"))
    return named.join(ids, "content_hash").join(own.withColumnRenamed("id", "root"), "cluster_id").select("id", "root")


def stream_source_streaks(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events")
    polls = tables.polls_of(spark.readStream.schema(raw.schema).parquet(f"{d}/event[s].parquet"))
    path = work_path(spark, "streaks")
    streaks.streak_stream(polls, f"{path}/store", f"{path}/checkpoint", "36500 days")
    return streaks.latest(spark, f"{path}/store")


def blob_put(spark: SparkSession, d: str) -> DataFrame:
    """Documents of even ids as blobs, then all of them: each content once."""
    items = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.encode("text", "utf-8").alias("content"))
    folder = work_path(spark, "blobs")
    for n in (2, 1):
        snapshots.write_blobs(items.filter(F.col("doc_id") % n == 0).drop("doc_id"), folder)
    return snapshots.read_blobs(spark, folder).select("content_hash", "blob_uri", F.octet_length("content").alias("n_bytes"))


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").filter("url IS NOT NULL AND html IS NOT NULL")
    return p.select("page_id", tx.netloc(F.col("url")).alias("host"), "html").filter("host <> ''")


#: Pages of a site that one task reads, some of them closed.
SITE_PAGES = 2000


def site_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as stored answers of their hosts, whose robots files close what ids ending in 7 have, read by the format "site"."""
    p = _hosts(spark, d)
    kind = F.when(F.col("page_id") % 10 == 7, "closed").otherwise("open")
    own = p.select("host", F.concat(F.lit("https://"), "host", F.lit("/"), kind, F.lit("/"), F.col("page_id").cast("string")).alias("url"), F.encode("html", "utf-8").alias("body"))
    hosts = own.groupBy("host").agg(F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))), "").alias("x"))
    at = lambda name, text: hosts.select("host", F.concat(F.lit("https://"), "host", F.lit(name)).alias("url"), F.encode(text, "utf-8").alias("body"))
    robots = at("/robots.txt", F.concat(F.lit("User-agent: *\nDisallow: /closed\nSitemap: https://"), "host", F.lit("/map.xml\n")))
    maps = at("/map.xml", F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")))
    folder = work_path(spark, "answers")
    all_ = own.unionByName(robots).unionByName(maps).withColumns({"status": F.lit(200), "fetched_at": F.lit("2024-01-01").cast("timestamp")})
    # in the order of urls and in small row groups, so that a task reads its own pages
    all_.drop("host").repartitionByRange("url").sortWithinPartitions("url").write.option("parquet.block.size", 4 << 20).parquet(folder)
    parts = {f"https://{r.host}/": r.parts for r in own.groupBy("host").agg(F.ceil(F.count("*") / SITE_PAGES).alias("parts")).orderBy("host").collect()}
    found = answers.asked(answers.register(spark).read.format("site"), list(parts), folder, site={"max_documents": None}, parts=parts).load()
    return found.select("endpoint", "url", F.md5("html").alias("html_md5"))


def conditional_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Hosts as sources whose pages are endpoints: two polls, the second one conditional where a host has one page."""
    p = _hosts(spark, d).withColumn("url", F.concat(F.lit("u"), F.col("page_id").cast("string")))
    sources = written(p.groupBy(F.col("host").alias("source_id")).agg(F.array_sort(F.collect_list("url")).alias("endpoints")), "sources")
    states = spark.createDataFrame([], conditional.STATE)
    first = written(conditional.requests(sources, states), "requests")
    page, etag = F.substring("url", 2, 20).cast("long"), F.concat(F.lit("v"), "url")
    said = first.select("url", F.lit(200).alias("status"), etag.alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    states = written(conditional.merged(states, first, said, datetime(2024, 1, 1)), "states")
    second = written(conditional.requests(sources, states), "requests")
    status = F.when(page % 5 == 0, 500).when(F.col("etag") == etag, 304).otherwise(200)
    again = second.select("url", status.alias("status"), F.lit(None).cast("string").alias("etag"), F.lit("now").alias("last_modified"))
    states = states.unionByName(conditional.merged(states, second, again, datetime(2024, 1, 2)))
    held = conditional.current(states).groupBy("source_id").agg(F.count_if(F.col("last_modified").isNotNull()).alias("renewed"))
    asked = second.groupBy("source_id").agg(F.count("etag").alias("conditional"))
    return conditional.outcomes(second, again).join(asked, "source_id").join(held, "source_id")


def brief_bodies(spark: SparkSession, d: str) -> DataFrame:
    """A brief for every source: the verdicts of all claims that it takes part in, under their stories."""
    c = written(_claims(spark, d), "claims")
    done = written(corroborate.corroborate_events(c, POLICY).withColumn("body_id", F.explode("sources")), "verdicts")
    asked = done.select("body_id", F.explode("sids").alias("sid")).distinct()
    seen = asked.join(c.select("sid", F.col("claim").alias("text")), "sid").select("body_id", "sid", F.lit(None).cast("string").alias("title"), "text")
    return verify.brief_bodies(done, seen)


def sparse_topk_pruned(spark: SparkSession, d: str) -> DataFrame:
    """sparse_topk by blocks with upper bounds."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    blocks = block_max.build(written(index.postings(docs), "postings"), docs.count())
    hits = block_max.search(index.postings(asked).withColumnRenamed("id", "query_id"), blocks, 10)
    return hits.rows.withColumn("score", F.round("score", 6))


def corroborate_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """Events under the policies that flag and that drop what is not confirmed."""
    c, out = written(_claims(spark, d), "claims"), None
    groups = written(corroborate.event_groups(c), "groups")
    for fallback in ("flag", "drop"):
        done = corroborate.corroborate_events(c, corroborate.Policy(2, 1, fallback), groups).select(F.lit(fallback).alias("fallback"), "claim_group", "verdict", "dropped")
        out = done if out is None else out.unionByName(done)
    return out


def quants_relative(spark: SparkSession, d: str) -> DataFrame:
    """Quantities that agree within three tenths of the larger one."""
    out = corroborate.corroborate_quantities(_quantities(spark, d), POLICY, 0.3, None)
    return out.select("entity_id", "as_of", "text", "verdict", "independent_voices", "tier1_voices", "sources", "conflict", "dropped")


def governance_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Candidate hosts with decisions that contradict each other: the latest one counts; entries to review of those approved."""
    found = written(candidates_propose(spark, d).withColumn("title", F.lit(None).cast("string")), "candidates")
    n = F.length("netloc")
    log = lambda keep, day, status, reason: found.filter(keep).select("netloc", F.lit(f"2024-01-{day:02}").cast("timestamp").alias("decided_at"), F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    logged = log(n % 2 == 0, 1, "approved", None).unionByName(log(n % 3 == 0, 2, "rejected", "off topic"))
    done = governance.decided(found, logged)
    shown = governance.stanza(governance.listed(done, "all"))
    return shown.select("netloc", "status", "reason", F.when(F.col("status") == "approved", F.col("yaml")).alias("yaml"))


def feed_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every source's documents as a stored feed, read by the format "feed": what is later than a time or has no date."""
    docs = table(spark, d, "documents").filter("source IS NOT NULL")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    dated = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("<pubDate>"), at, F.lit("</pubDate>"))).otherwise("")
    item = F.concat(F.lit("<item><title>"), F.col("doc_id").cast("string"), F.lit("</title><description>"), F.coalesce(F.md5("text"), F.lit("")), F.lit("</description>"), dated, F.lit("</item>"))
    feeds = docs.groupBy("source").agg(F.array_join(F.collect_list(item), "").alias("x"))
    rows = feeds.select(F.concat(F.lit("feed://"), "source").alias("url"), F.lit(200).alias("status"), F.encode(F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>")), "utf-8").alias("body"), F.lit("2024-06-01").cast("timestamp").alias("fetched_at"))
    folder = work_path(spark, "answers")
    rows.write.parquet(folder)
    endpoints = [r.url for r in spark.read.parquet(folder).select("url").orderBy("url").collect()]
    found = answers.asked(answers.register(spark).read.format("feed"), endpoints, folder, datetime(2024, 1, 8)).load()
    return found.select("endpoint", F.col("title").cast("long").alias("doc_id"), "content", "published_at")


def clusters_by_batches(spark: SparkSession, d: str) -> DataFrame:
    """Near copies in the order of their ids, put into a component index in two batches: a text belongs to the cluster of
    the first text before it that it is alike with."""
    texts = written(_texts(spark, d), "texts")
    pairs = written(near_duplicates.similar_pairs(texts).select("a", "b"), "pairs")
    middle = texts.agg(F.percentile_approx("id", 0.5)).first()[0] or 0
    nodes = texts.select(F.col("id").alias("node"), F.col("id").alias("at"))
    store = ComponentIndex(spark, work_path(spark, "clusters"))
    store.add(nodes.filter(F.col("node") <= middle), pairs.filter(F.col("b") <= middle))
    store.add(nodes.filter(F.col("node") > middle), pairs.filter(F.col("b") > middle))
    return store.clusters().select(F.col("node").alias("id"), "cluster")


QUERIES = {f.__name__: f for f in (
    benchmark_hits, chunks_recursive, ivf_recall, stream_signature_clusters, stream_source_streaks, blob_put, site_pages, conditional_outcomes,
    brief_bodies, sparse_topk_pruned, corroborate_fallbacks, quants_relative, governance_decisions, feed_scan,
    clusters_by_batches,
)}
