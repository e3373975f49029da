import gzip
import os
from datetime import datetime

import pytest

from attestry.operators.entities import Dictionary
from attestry.sources import config, readers, sites

RSS = """<rss><channel><item><title>One</title><link>http://a/1</link><description>First body</description><pubDate>Mon, 04 Mar 2024 10:00:00 GMT</pubDate></item>
<item><title>Two</title><link>http://a/2</link></item><item><title>Old</title><link>http://a/3</link><pubDate>Fri, 01 Mar 2024 10:00:00 +0000</pubDate></item></channel></rss>"""


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS)
    got = {r.title: (r.content, r.published_at) for r in readers.read_feed(spark, str(tmp_path), datetime(2024, 3, 2)).collect()}
    assert got == {"One": ("First body", datetime(2024, 3, 4, 10)), "Two": ("Two", None)}


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": {"items": [{"u": "http://x", "meta": {"t": "T"}, "d": "2024-03-05T00:00:00Z"}]}}')
    r = readers.read_json(spark, str(tmp_path), "data.items", {"url": "u", "title": "meta.t", "published_at": "d"}).first()
    assert (r.url, r.title, r.media_type, r.published_at) == ("http://x", "T", "application/json", datetime(2024, 3, 5)) and '"u"' in r.content


def test_folder(spark, tmp_path):
    os.makedirs(tmp_path / "in" / ".hid")
    for name, data in {"a.md": "hello", "b.html": "<p>x <b>y</b></p><script>z</script>", "c.bin": "?", ".d.md": "no", ".hid/e.md": "no"}.items():
        (tmp_path / "in" / name).write_text(data)
    got = {r.title: (r.media_type, r.text, r.extraction_status) for r in readers.extract_text(readers.read_folder(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a": ("text/markdown", "hello", "ok"), "b": ("text/html", "x y", "ok"), "c": ("application/octet-stream", "", "unsupported")}


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><entry><title>A</title><link rel="self" href="http://a/self"/><link href="http://a/1"/><summary>Short</summary><content type="html">Long body</content><published>2024-03-04T10:00:00Z</published></entry>
<entry><title>B</title><id>urn:b</id><updated>2024-03-01T00:00:00Z</updated></entry></feed>"""


def test_atom_and_full_pages(spark, tmp_path):
    (tmp_path / "f.xml").write_text(ATOM)
    got = {r.title: (r.url, r.content, r.published_at) for r in readers.read_feed(spark, str(tmp_path)).collect()}
    assert got == {"A": ("http://a/1", "Long body", datetime(2024, 3, 4, 10)), "B": ("urn:b", "B", datetime(2024, 3, 1))}
    pages = spark.createDataFrame([("http://a/1", "<p>The full <b>page</b></p>"), ("urn:b", "<p></p>")], "url string, html string")
    full = {r.title: r.content for r in readers.read_feed(spark, str(tmp_path), fetch=lambda urls: urls.join(pages, "url")).collect()}
    assert full == {"A": "The full page", "B": "B"}


def test_json_without_a_list(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": {"items": 5}}')
    with pytest.raises(Exception, match="holds no list"):
        readers.read_json(spark, str(tmp_path), "data.items", {}).collect()


def test_extraction(spark):
    rows = [(1, "application/json", b'{"a":[1,"\xc3\xa9"]}'), (2, "application/json", b"{"), (3, "text/plain", b"  \n"), (4, "text/csv", b" a,b\n"), (5, "application/pdf", b"x"), (6, "text/html", None), (7, "application/pdf", b"long enough for a text layer")]
    items = spark.createDataFrame(rows, "n int, media_type string, content binary")
    got = {r.n: (r.extraction_status, r.text) for r in readers.extract_text(items).collect()}
    assert got == {1: ("ok", '{\n "a": [\n  1,\n  "é"\n ]\n}'), 2: ("failed", ""), 3: ("empty", ""), 4: ("ok", "a,b"), 5: ("unsupported", ""), 6: ("empty", ""), 7: ("unsupported", "")}
    pdf = {r.n: r.extraction_status for r in readers.extract_text(items, pdf=lambda c: c.cast("string")).collect()}
    assert (pdf[5], pdf[7]) == ("empty", "ok")
    dated = readers.published(spark.createDataFrame([(None, datetime(1970, 1, 2))], "published_at timestamp, fetched_at timestamp")).first()
    assert (dated.published_at, dated.published_ts) == (datetime(1970, 1, 2), 86400)


ROBOTS = """# all
User-agent: a
User-agent: b
Disallow: /

User-Agent: *
Allow: /private/open
Disallow: /private
Disallow: /tmp*
Sitemap: http://s/m.xml
Sitemap: http://s/n.xml.gz
"""


def answers(spark, rows):
    return spark.createDataFrame([(u, c, b) for u, c, b in rows], "url string, status int, body binary")


def test_robots(spark):
    a = answers(spark, [("http://s/robots.txt", 200, ROBOTS.encode()), ("http://gone/robots.txt", 404, b"User-agent: *\nDisallow: /"), ("http://all/robots.txt", 200, b"User-agent: *\nDisallow:\n")])
    urls = ["http://s/", "http://s", "http://s/private/x", "http://s/private/open/x", "http://s/tmpx", "http://s?q", "http://gone/x", "http://all/x", "http://unknown/x"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {u for u in urls} - {r.url for r in sites.permitted(pages, sites.robots_rules(a)).collect()} == {"http://s/private/x", "http://s/tmpx"}
    assert {r.url for r in sites.permitted(pages, sites.robots_rules(a, "B")).collect()} == {u for u in urls if not u.startswith("http://s")}
    assert [(r.host, r.url) for r in sites.declared_sitemaps(a).orderBy("n").collect()] == [("s", "http://s/m.xml"), ("s", "http://s/n.xml.gz")]


def test_sitemap_roots(spark):
    a = answers(spark, [("http://s/robots.txt", 200, ROBOTS.encode()), ("http://t/sitemap_index.xml", 200, b"<?xml?><SitemapIndex>"), ("http://t/sitemap.xml", 404, b"")])
    at = lambda *u: spark.createDataFrame(list(enumerate(u)), "n int, url string")
    got = lambda *x: [r.url for r in sites.sitemap_roots(*x, a).orderBy("n").collect()]
    assert got(at("http://s/x"), ["http://s/n.xml.gz", "http://e/1"]) == ["http://s/n.xml.gz", "http://e/1", "http://s/m.xml"]
    assert got(at("http://t"), []) == ["http://t/sitemap_index.xml"] and got(at("http://u"), []) == []


def test_sitemap_documents():
    xml = b'<?xml version="1.0"?><urlset xmlns="x" xmlns:i="y"><url><i:image><i:loc>http://img</i:loc></i:image><loc> http://a </loc><lastmod>2024-01-01</lastmod><n:news xmlns:n="z"><n:title>T</n:title></n:news></url><url><lastmod>x</lastmod></url></urlset>'
    want = [("page", "http://a", "2024-01-01", "T")]
    assert sites.parse_sitemap("http://m", xml) == want == sites.parse_sitemap("http://m.gz", gzip.compress(xml)) == sites.parse_sitemap("http://m.gz", xml)
    assert sites.parse_sitemap("http://m", b"<broken") == sites.parse_sitemap("http://m", None) == sites.parse_sitemap("http://m", b"\x1f\x8bno") == []


def test_sitemap_walk(spark):
    rows = [("http://s/m", "http://s/n/", "sitemap", None), ("http://s/n", "http://s/m", "sitemap", None), ("http://s/m", "http://s/a", "page", datetime(2024, 1, 1)), ("http://s/n", "http://s/private/b", "page", None), ("http://s/n", "http://s/c.pdf", "page", None)]
    e = spark.createDataFrame(rows, "sitemap string, loc string, kind string, lastmod timestamp")
    walk = lambda **k: sorted(r.url for r in sites.walk_sitemaps(e, ["http://s/m/"], **k).collect())
    assert walk(exclude=r"\.PDF$") == ["http://s/a", "http://s/private/b"] and walk(max_documents=1) == ["http://s/a"] == walk(max_depth=0)
    assert walk(after=datetime(2024, 1, 1)) == ["http://s/c.pdf", "http://s/private/b"] and walk(include="PRIVATE", max_pages=1) == ["http://s/private/b"]


def test_site_scan(spark):
    page = lambda t, n=60: f"<title>{t}</title><p>{'words about it ' * n}</p>".encode()
    index = b"<sitemapindex><sitemap><loc>http://s/n.xml.gz</loc></sitemap></sitemapindex>"
    urls = b"".join(b"<url><loc>%s</loc></url>" % u for u in (b"http://s/a", b"http://s/private/b", b"http://other/c", b"http://s/thin"))
    a = answers(spark, [("http://s/robots.txt", 200, ROBOTS.encode()), ("http://s/m.xml", 200, index), ("http://s/n.xml.gz", 200, gzip.compress(b"<urlset>" + urls + b"</urlset>")), ("http://s/a", 200, page("A")), ("http://s/private/b", 200, page("B")), ("http://other/c", 200, page("C")), ("http://s/thin", 200, page("D", 2))])
    assert [(r.url, r.title) for r in sites.read_site(["http://s/"], sites.stored_answers(a), spark).collect()] == [("http://s/a", "A")]
    with pytest.raises(ValueError, match="no sitemap"):
        sites.read_site(["http://none"], sites.stored_answers(a), spark)


def test_crawl_filters(spark):
    pages = spark.createDataFrame([("u1", "<title>Hormuz</title>" + "long text " * 50), ("u2", "<p>short</p>"), ("u3", "other text " * 50)], "url string, html string")
    got = readers.crawled(pages, 400, Dictionary([("Hormuz", "h", "p")])).collect()
    assert [(r.url, r.title) for r in got] == [("u1", "Hormuz")]


def test_unknown_adapter():
    with pytest.raises(ValueError, match="unknown adapter"):
        readers.adapter("ftp")


def test_configuration(spark, tmp_path):
    reg = tmp_path / "r.yaml"
    one = "- {id: un_news, name: UN, license: cc, fetch: {adapter: rss, endpoints: [x]}, tags: {general: {tier: 1}}}\n"
    reg.write_text("sources:\n" + one)
    assert config.load_registry(spark, str(reg)).first().independence_group == "un_news"
    for bad in ("", one + one, one.replace("tier: 1", "tier: 4"), one.replace("license: cc, ", ""), one.replace("un_news", "Un News")):
        reg.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load_registry(spark, str(reg))
    p = tmp_path / "p.yaml"
    p.write_text("domain: d\nregistry_scope: {include_tags: [general]}\nclaims: {quantitative: {tolerance: {relative: 0.005}}}\ncorroboration: {fallback: drop, quantitative: {value_tolerance: 0.1}}\n")
    got = config.load_profile(str(p))
    assert (got.relative, got.event.fallback, got.min_tier, got.top_k) == (0.1, "drop", 3, 24)
    home = tmp_path / "domains" / "one"
    home.mkdir(parents=True)
    (home / "profile.yaml").write_text("domain: one\nregistry_scope: {include_tags: [x]}\nentities: {dictionaries: [{path: e.csv}, {path: gone.csv}]}\n")
    (home / "e.csv").write_text("surface_form,canonical_id,type\nBrent crude,brent,oil\nBrent crude,brent,oil\n")
    assert config.load_dictionaries(str(tmp_path / "domains")) == [("Brent crude", "brent", "oil")]
    d = tmp_path / "d.csv"
    d.write_text("surface_form,canonical_id,type\n#,x,y\nBrent crude,brent,oil\nWTI\n\n")
    assert config.load_dictionary(str(d)) == [("Brent crude", "brent", "oil"), ("WTI", "WTI", "")]
