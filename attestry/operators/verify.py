"""Citations and their verification, and the brief that bears them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CITATION, is_structural, overlap_supported, sids, split_sentences, strings, strip_verdict_labels, tokenize, verdict_label

BLANK = " \t\n\r\f\x0b"


def body_sentences(bodies: DataFrame) -> DataFrame:
    """(body_id, line, pos, sentence) of bodies (body_id, body): prose only, no headings or rules."""
    lines = bodies.select("body_id", F.posexplode(F.split("body", r"\R")).alias("line", "t")).withColumn("t", F.btrim("t", F.lit(BLANK)))
    return lines.filter((F.col("t") != "") & ~is_structural(F.col("t"))).select("body_id", "line", F.posexplode(split_sentences(F.col("t"))).alias("pos", "sentence"))


def validate_citations(bodies: DataFrame, evidence: DataFrame) -> DataFrame:
    """Take citations that the evidence (body_id, sid) does not have out of bodies (body_id, body).

    Adds cleaned, cited (sids in numeric order), uncited (sentences without a citation, headings aside)
    and invalid (citations taken out).
    """
    found = bodies.select("body_id", F.explode(F.regexp_extract_all("body", F.lit(CITATION), F.lit(0))).alias("m")).groupBy("body_id", "m").agg(F.count("*").alias("n"))
    own = evidence.select("body_id", F.concat(F.lit("["), "sid", F.lit("]")).alias("m")).distinct()
    unknown = found.join(own, ["body_id", "m"], "left_anti").groupBy("body_id").agg(F.array_sort(F.collect_list("m")).alias("_bad"), F.sum("n").alias("invalid"))
    rows = bodies.join(unknown, "body_id", "left").withColumn("_bad", F.coalesce("_bad", strings([]))).withColumn("invalid", F.coalesce("invalid", F.lit(0)))
    cleaned = F.aggregate("_bad", F.col("body"), lambda b, m: F.replace(b, m, F.lit("")))
    rows = rows.withColumn("_clean", cleaned)
    prose = F.filter(F.transform(F.split("_clean", r"\R"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: (x != "") & ~x.startswith("#"))
    bare = F.filter(F.flatten(F.transform(prose, split_sentences)), lambda s: ~s.rlike(CITATION))
    return rows.select("body_id", "body", F.btrim("_clean", F.lit(BLANK)).alias("cleaned"), sids(F.col("_clean")).alias("cited"), F.size(bare).alias("uncited"), "invalid")


def check_bodies(bodies: DataFrame, evidence: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Check each sentence of bodies against the texts it cites (evidence: body_id, sid, text).

    A sentence without citations is not supported, unknown ids are passed over, verdict labels are not
    checked; a sentence without tokens is supported. Adds sids and supported to body_sentences.
    """
    s = body_sentences(bodies).withColumn("sids", sids(F.col("sentence")))
    cited = s.select("body_id", "line", "pos", F.explode("sids").alias("sid")).join(evidence.select("body_id", "sid", tokenize(F.col("text")).alias("t")), ["body_id", "sid"])
    pool = cited.groupBy("body_id", "line", "pos").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("pool"))
    judged = s.join(pool, ["body_id", "line", "pos"], "left")
    ok = overlap_supported(strip_verdict_labels(F.col("sentence")), F.coalesce("pool", strings([])), threshold)
    return judged.withColumn("supported", (F.size("sids") > 0) & ok).drop("pool")


def precision(checks: DataFrame) -> DataFrame:
    """(body_id, checked, failed, precision) of checked bodies; the share of supported sentences."""
    per = checks.groupBy("body_id").agg(F.count("*").alias("checked"), F.count_if(~F.col("supported")).alias("failed"))
    return per.withColumn("precision", (F.col("checked") - F.col("failed")) / F.col("checked"))


def drop_unsupported(bodies: DataFrame, checks: DataFrame) -> DataFrame:
    """Take sentences that failed, and all equal to one, out of bodies; lines that lose all of them go.

    Adds shipped and n_dropped; a body without failures stays as it is.
    """
    bad = checks.filter(~F.col("supported")).groupBy("body_id").agg(F.collect_set(F.btrim("sentence", F.lit(BLANK))).alias("_bad"))
    rows = bodies.join(bad, "body_id", "left").withColumn("_bad", F.coalesce("_bad", strings([])))

    def line(x):
        own = F.transform(split_sentences(F.btrim(x, F.lit(BLANK))), lambda s: F.btrim(s, F.lit(BLANK)))
        kept = F.filter(own, lambda s: ~F.array_contains("_bad", s))
        n = F.size(own) - F.size(kept)
        plain = (F.btrim(x, F.lit(BLANK)) == "") | is_structural(x)
        return F.when(plain, F.struct(x.alias("t"), F.lit(0).alias("n"))).otherwise(F.struct(F.when(F.size(kept) > 0, F.array_join(kept, " ")).alias("t"), n.alias("n")))

    rows = rows.withColumn("_lines", F.transform(F.split("body", r"\R"), line))
    some = F.size("_bad") > 0
    shipped = F.btrim(F.array_join(F.filter(F.transform("_lines", lambda x: x["t"]), lambda t: t.isNotNull()), "\n"), F.lit(BLANK))
    return rows.select("body_id", "body", F.when(some, shipped).otherwise(F.col("body")).alias("shipped"), F.when(some, F.aggregate(F.transform("_lines", lambda x: x["n"]), F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0)).alias("n_dropped"))


def brief_bodies(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(body_id, body): the extractive brief of corroborated claims (body_id, claim_group, text, verdict,
    independent_voices, sources, sids, conflict, story_cluster, dropped) over evidence (body_id, sid, title, text).

    One line per claim in order of claim_group, under its story's headline; stories come in order of their
    first claim. A headline is the title, else the first line, of the first evidence its first claim has.
    """
    live = claims.filter(~F.col("dropped")).withColumn("story", F.coalesce("story_cluster", F.lit("")))
    label = verdict_label(F.col("verdict"), F.col("independent_voices"), F.col("sources"), F.col("conflict"))
    text = F.regexp_replace(F.btrim(F.regexp_replace("text", r"\s+", " ")), r"\.+$", "")
    marks = F.array_join(F.transform("sids", lambda s: F.concat(F.lit("["), s, F.lit("]"))), "")
    live = live.withColumn("out", F.concat(text, F.lit(" ("), label, F.lit("). "), marks))
    head = F.coalesce(F.nullif("title", F.lit("")), F.substring(F.element_at(F.split("text", r"\R"), 1), 1, 90))
    cited = live.select("body_id", "story", "claim_group", F.posexplode("sids").alias("i", "sid")).join(evidence.select("body_id", "sid", head.alias("head")), ["body_id", "sid"])
    heads = cited.groupBy("body_id", "story").agg(F.min_by("head", F.struct("claim_group", "i")).alias("head"))
    lines = live.groupBy("body_id", "story").agg(F.min("claim_group").alias("first"), F.array_sort(F.collect_list(F.struct("claim_group", "out"))).alias("rows"))
    sections = lines.join(heads, ["body_id", "story"], "left").withColumn("head", F.coalesce("head", F.nullif("story", F.lit("")), F.lit("Untitled")))
    section = F.concat(F.lit("### "), "head", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["out"]), "\n"))
    return sections.groupBy("body_id").agg(F.array_sort(F.collect_list(F.struct("first", section.alias("s")))).alias("all")).select("body_id", F.array_join(F.transform("all", lambda x: x["s"]), "\n\n").alias("body"))


def evidence_ids(evidence: DataFrame) -> DataFrame:
    """Number each body's evidence (body_id, ord, ...) S1, S2, ... by ord."""
    return evidence.withColumn("sid", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("body_id").orderBy("ord")).cast("string")))
