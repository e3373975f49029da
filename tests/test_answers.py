"""Stored answers as data sources, conditional requests."""

import gzip
import json
from datetime import datetime

import pytest

from attestry.plans import polling
from attestry.sources import answers, conditional, readers, sites
from attestry.sources.config import Profile

ANSWER = "url string, status int, body binary, fetched_at timestamp, etag string, last_modified string"


def feed(*items):
    rows = "".join(f"<item><title>{t}</title><link>http://f/{t}</link>{f'<pubDate>{d}</pubDate>' if d else ''}</item>" for t, d in items)
    return f"<rss><channel>{rows}</channel></rss>".encode()


def save(spark, folder, rows):
    spark.createDataFrame([(u, s, b, datetime(2024, 3, d), None, None) for u, s, b, d in rows], ANSWER).write.mode("append").parquet(folder)


def test_feeds_say_what_the_xml_reader_says(spark, tmp_path):
    atom = b"""<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>A</title><link rel="self" href="http://a/self"/><link href="http://a/1"/><summary>Short</summary>
    <content type="html">Long body</content><published>2024-03-04T10:00:00Z</published></entry><entry><title>B</title><id>urn:b</id><updated>2024-03-01T00:00:00+01:00</updated></entry></feed>"""
    (tmp_path / "f.xml").write_bytes(atom)
    save(spark, f"{tmp_path}/answers", [("http://a/feed", 200, feed(("old", None)), 1), ("http://a/feed", 200, atom, 2), ("http://a/feed", 500, b"no", 3)])
    got = answers.feed_items(spark, "http://a/feed", answers=f"{tmp_path}/answers").orderBy("title").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in readers.read_feed(spark, str(tmp_path / "f.xml")).orderBy("title").collect()]
    late = answers.feed_items(spark, "http://a/feed", datetime(2024, 3, 2), f"{tmp_path}/answers").collect()
    assert [r.title for r in late] == ["A"]
    assert readers.adapter("feed")(spark, "http://nobody", answers=f"{tmp_path}/answers").collect() == []
    with pytest.raises(ValueError, match="where are the answers"):
        readers.adapter("site")(spark, "http://nobody")


def test_marks_of_a_feed_stream(spark, tmp_path):
    """Each endpoint has its own mark, kept in the checkpoint over restarts; a failed answer moves none."""
    folder, out = f"{tmp_path}/answers", f"{tmp_path}/out"
    answers.register(spark)

    def run():
        stream = answers.asked(spark.readStream.format("feed"), ["http://a", "http://b"], folder).load()
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        return sorted(r.title for r in spark.read.schema(stream.schema).parquet(out).collect())

    save(spark, folder, [("http://a", 200, feed(("a1", "Fri, 01 Mar 2024 00:00:00 GMT"), ("a2", None)), 5), ("http://b", 503, b"", 5)])
    assert run() == ["a1", "a2"]
    assert run() == ["a1", "a2"]
    # a1 is not later than the mark of a, an undated one comes again; b has no mark yet
    save(spark, folder, [("http://a", 200, feed(("a1", "Fri, 01 Mar 2024 00:00:00 GMT"), ("a2", None), ("a3", "Thu, 07 Mar 2024 00:00:00 GMT")), 8), ("http://b", 200, feed(("b1", "Fri, 01 Mar 2024 00:00:00 GMT")), 6)])
    assert run() == ["a1", "a2", "a2", "a3", "b1"]
    save(spark, folder, [("http://a", 304, None, 9), ("http://b", 500, b"", 9)])
    assert run() == ["a1", "a2", "a2", "a3", "b1"]


def site(host):
    pages = {f"http://{host}/{p}": f"<html><head><title>{p}</title></head><body><p>{'word ' * 100}{p}</p></body></html>" for p in ("open", "private/x", "news/1", "news/2")}
    urls = "".join(f"<url><loc>{u}</loc>{'<lastmod>2024-03-0%d</lastmod>' % (n + 1) if n else ''}</url>" for n, u in enumerate(pages))
    index = f"<sitemapindex><sitemap><loc>http://{host}/m.xml.gz</loc></sitemap><sitemap><loc>http://{host}/i.xml</loc></sitemap></sitemapindex>"
    urlset = f"<urlset>{urls}<url><loc>http://other/page</loc></url></urlset>"
    return [
        (f"http://{host}/robots.txt", 200, f"User-agent: *\nDisallow: /private\nSitemap: http://{host}/i.xml\n".encode(), 1),
        (f"http://{host}/i.xml", 200, index.encode(), 1), (f"http://{host}/m.xml.gz", 200, gzip.compress(urlset.encode()), 1),
        ("http://other/page", 200, b"<p>" + b"x " * 300 + b"</p>", 1), *((u, 200, b.encode(), 1) for u, b in pages.items()),
    ]


def test_sites_say_what_read_site_says(spark, tmp_path):
    rows = site("s") + [r for r in site("t") if "robots" not in r[0]] + [("http://t/sitemap.xml", 200, b"<urlset><url><loc>http://t/open</loc></url></urlset>", 1)]
    save(spark, f"{tmp_path}/answers", rows)
    stored = spark.read.parquet(f"{tmp_path}/answers")
    fetch = sites.stored_answers(stored.select("url", "status", "body"))
    for options in (sites.SiteOptions(), sites.SiteOptions(include="news", exclude="2$"), sites.SiteOptions(max_pages=1)):
        for endpoint in ("http://s/", "http://t/start"):
            want = sites.read_site([endpoint], fetch, spark, options).collect()
            got = answers.site_items(spark, endpoint, answers=f"{tmp_path}/answers", options=options).collect()
            assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    many = answers.asked(answers.register(spark).read.format("site"), ["http://s/", "http://t/"], f"{tmp_path}/answers").load()
    assert many.rdd.getNumPartitions() == 2 and {(r.endpoint, r.title or r.url) for r in many.collect()} >= {("http://s/", "http://s/open"), ("http://t/", "http://t/open")}
    with pytest.raises(Exception, match="no sitemap found"):
        answers.site_items(spark, "http://nobody/", answers=f"{tmp_path}/answers").collect()


def test_conditional_requests(spark, tmp_path):
    sources = spark.createDataFrame([("one", ["http://one"]), ("two", ["http://two/a", "http://two/b"])], "source_id string, endpoints array<string>")
    states = spark.createDataFrame([], conditional.STATE)
    said = lambda rows: spark.createDataFrame(rows, "url string, status int, etag string, last_modified string")
    asked = conditional.requests(sources, states)
    assert {tuple(r) for r in asked.collect()} == {("one", "http://one", None, None), ("two", "http://two/a", None, None), ("two", "http://two/b", None, None)}
    first = said([("http://one", 200, "v1", "Monday"), ("http://two/a", 200, "w1", None)])
    assert {tuple(r) for r in conditional.outcomes(asked, first).collect()} == {("one", "ok"), ("two", "error")}
    states = states.unionByName(conditional.merged(states, asked, first, datetime(2024, 3, 1)))
    asked = conditional.requests(sources, states)
    # two endpoints are never asked conditionally
    assert {tuple(r) for r in asked.collect()} == {("one", "http://one", "v1", "Monday"), ("two", "http://two/a", None, None), ("two", "http://two/b", None, None)}
    second = said([("http://one", 304, None, None), ("http://two/a", 304, None, None), ("http://two/b", 304, None, None)])
    assert {r.status for r in conditional.outcomes(asked, second).collect()} == {"not_modified"}
    states = states.unionByName(conditional.merged(states, asked, second, datetime(2024, 3, 2)))
    third = said([("http://one", 500, "bad", None)])
    states = states.unionByName(conditional.merged(states, asked, third, datetime(2024, 3, 3)))
    fourth = said([("http://one", 200, "v2", None)])
    held = lambda: {r.source_id: (r.etag, r.last_modified, r.status) for r in conditional.current(states).collect()}
    assert held()["one"] == ("v1", "Monday", 500)
    states = states.unionByName(conditional.merged(states, asked, fourth, datetime(2024, 3, 4)))
    assert held()["one"] == ("v2", "Monday", 200)


def test_polls_that_ask_conditionally(spark, tmp_path):
    """200, 304, a store that breaks, 200 again: validators move only with the items."""
    from attestry.operators.registry import SCHEMA

    sources = spark.createDataFrame([("one", "One", "feed", "en", "x", {"t": 1}, "one", "active", ["http://one"])], SCHEMA)
    store, asked, replies = polling.Store(spark, f"{tmp_path}/store"), [], []

    def request(wanted):
        rows = [tuple(r) for r in wanted.collect()]
        asked.extend(rows)
        status, body, etag = replies.pop(0)
        return spark.createDataFrame([(r[1], status, body, etag, None) for r in rows], "url string, status int, body binary, etag string, last_modified string")

    day = iter(datetime(2024, 3, d) for d in range(1, 29))
    clock = lambda: next(day)
    reader = polling.ConditionalReader(store, request, clock)
    run = lambda: polling.poll(store, sources, Profile("d", ["t"]), reader, clock=clock)[0]
    replies += [(200, feed(("a", None)), "v1"), (304, None, None), (200, feed(("b", None)), "v2"), (200, feed(("b", None)), "v2"), (404, None, None)]
    assert (run()["status"], run()["status"]) == ("ok", "not_modified")
    put, store.put = store.put, lambda items: (_ for _ in ()).throw(OSError("disk full"))
    assert run()["status"] == "error"
    store.put = put
    assert (lambda r: (r["status"], r["snapshots_new"]))(run()) == ("ok", 1)
    assert run()["status"] == "error"
    assert [a[2] for a in asked] == [None, "v1", "v1", "v1", "v2"]
    assert [r.status for r in store.events.orderBy("started_at").collect()] == ["ok", "not_modified", "error", "ok", "error"]


def test_dates():
    assert answers.parsed_date("Mon, 04 Mar 2024 10:00:00 +0100") == datetime(2024, 3, 4, 9) and answers.parsed_date("2024-03-04") == datetime(2024, 3, 4)
    assert answers.parsed_date("soon") is None and json.dumps(answers.FeedStream({"answers": "x", "endpoints": "[]"}).initialOffset()) == "{}"
