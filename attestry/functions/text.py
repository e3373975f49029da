"""Text, hash and URL expressions. All are built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no tokens; fixed list.
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were will with "
    "not but they their there been being over under after before between into through during"
).split()
#: Fixed patterns.
TOKEN = r"[a-z0-9][a-z0-9\-\._/]*"
EMBED_TOKEN = r"[a-z0-9]+"
CITATION = r"\[S\d+\]"
QUANT = (
    r"(?i)\b(price|prices|premium|premiums|rate|rates|output|production|volume)\b"
    r"[^.\n]*?\b(?:to|at|of|reached)\s+\$?(\d+(?:\.\d+)?)\s*(percent|%|per barrel|bbl|usd|dollars|mb/d)?"
)
DENIAL = r"(?i)\b(denied|denies|dismissed|rejected reports|no evidence)\b"
DIRECTION = r"(?i)\b(rose|climbed|increased|fell|dropped|declined|eased)\b"
NEGATIONS = ("denied", "deny", "denies", "no", "not", "never")
CONFLICT_LABEL = r"(?s)\(CONFLICTING REPORTS.*"
VERDICT_LABEL = r"\((?:confirmed by \d+ independent sources?|reported by [^)]*, unconfirmed|unverified)\)"
OG_TITLE = r"(?i)<meta[^>]+property=[\"']og:title[\"'][^>]+content=[\"']([^\"']+)"
TITLE = r"(?i)<title[^>]*>([^<]+)</title>"
DATES = (
    r"\"datePublished\"\s*:\s*\"([^\"]+)\"",
    r"(?i)<meta[^>]+property=[\"']article:published_time[\"'][^>]+content=[\"']([^\"']+)",
    r"(?i)<time[^>]+datetime=[\"']([^\"']+)",
)
#: The name space of URLs for name-based UUIDs.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"
STRUCTURAL = r"^(?:#|(?:-{3,}|\*{3,}|_{3,})\s*$)"


def strings(values) -> Column:
    """A literal array of strings, typed also when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def utf8(data: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(data.cast("binary").cast("string"))


def tokenize(text: Column) -> Column:
    """Content tokens in order: lower case, edges stripped of ``-._/``, two characters at least, no stopwords. Null: none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(F.transform(found, lambda t: F.btrim(t, F.lit("-._/"))), lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def token_index(token: Column) -> Column:
    """The first four bytes of the token's MD5 as an unsigned number."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")


def embed_tokens(text: Column) -> Column:
    """Tokens of the hashing embedding: every lower-case run of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(EMBED_TOKEN), F.lit(0))


def collapse(text: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def strip_html(html: Column) -> Column:
    """The text of a page: scripts, styles and tags go, white space is collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]+>", " "), r"\s+", " "))


def page_title(html: Column) -> Column:
    """og:title, or the title element where there is no og:title; trimmed, null if blank or neither."""
    og, own = F.regexp_extract(html, OG_TITLE, 1), F.regexp_extract(html, TITLE, 1)
    return F.nullif(F.btrim(F.when(og != "", og).otherwise(own), F.lit(" \t\n\r\f\x0b")), F.lit(""))


def page_published(html: Column) -> Column:
    """The first of datePublished, article:published_time and a time element that is a date; UTC. Else null."""
    return F.coalesce(*[F.try_to_timestamp(F.nullif(F.regexp_extract(html, f, 1), F.lit(""))) for f in DATES])


def netloc(url: Column) -> Column:
    """Lower-case host without a leading www.; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """A URL without its fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"/+$", "")


def origin(url: Column) -> Column:
    """Scheme and host of a URL, which may leave out the scheme (then https)."""
    full = F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def point_id(name: Column) -> Column:
    """The name-based UUID (version 5, URL space) of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def source_stub_id(host: Column) -> Column:
    """A registry id for a host."""
    return F.translate(host, ".-", "__")


def json_path(document: Column, path: str, default: Column | None = None) -> Column:
    """The value at a dotted path with list indices, or the default."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.coalesce(F.get_json_object(document, "$" + steps), default if default is not None else F.lit(None).cast("string"))


def sids(text: Column) -> Column:
    """The distinct citation ids of a text in numeric order."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)), lambda m: F.regexp_extract(m, r"\d+", 0).cast("long"))
    return F.transform(F.array_sort(F.array_distinct(numbers)), lambda n: F.concat(F.lit("S"), n.cast("string")))


def split_sentences(line: Column) -> Column:
    """Sentences of a line; citations that open a part belong to the sentence before it. Blank ones go."""
    parts = F.split(line, r"(?<=[.!?])\s+")
    lead = r"(?s)^((?:\[S\d+\]\s*)+)(.*)$"

    def add(done: Column, part: Column) -> Column:
        opens = part.rlike(lead) & (F.size(done) > 0)
        rest = F.btrim(F.regexp_extract(part, lead, 2))
        last = F.concat(F.element_at(done, -1), F.lit(" "), F.btrim(F.regexp_extract(part, lead, 1)))
        bound = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last), F.when(rest != "", F.array(rest)).otherwise(strings([])))
        return F.when(opens, bound).otherwise(F.concat(done, F.array(part)))

    plain = F.filter(parts, lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b")) != "")
    # the fold is only needed where a part may open with a citation
    folded = F.filter(F.aggregate(parts, strings([]), add), lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b")) != "")
    return F.when(line.contains("[S"), folded).otherwise(plain)


def strip_verdict_labels(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(sentence, CONFLICT_LABEL, ""), VERDICT_LABEL, ""))


def is_structural(line: Column) -> Column:
    """Headings and rules."""
    return F.btrim(line).rlike(STRUCTURAL)


def overlap_supported(sentence: Column, evidence_tokens: Column, threshold: float = 0.5) -> Column:
    """Whether the share of the sentence's distinct tokens that the evidence has reaches the threshold."""
    own = F.array_distinct(tokenize(F.regexp_replace(sentence, CITATION, "")))
    return F.element_at(F.transform(F.array(own), lambda t: F.when(F.size(t) == 0, F.lit(True)).otherwise(F.size(F.array_intersect(t, evidence_tokens)) / F.size(t) >= threshold)), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays as sets; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def verdict_label(verdict: Column, voices: Column, sources: Column, conflict: Column) -> Column:
    """What a brief says of a claim's verdict."""
    return (
        F.when(verdict == "confirmed", F.concat(F.lit("confirmed by "), voices.cast("string"), F.lit(" independent source"), F.when(voices != 1, F.lit("s")).otherwise(F.lit(""))))
        .when(verdict == "attributed", F.concat(F.lit("reported by "), F.array_join(sources, ", "), F.lit(", unconfirmed")))
        .when(verdict == "contradicted", F.concat(F.lit("CONFLICTING REPORTS — "), F.coalesce(conflict, F.lit("sources disagree"))))
        .otherwise(F.lit("unverified"))
    )
