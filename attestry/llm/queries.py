"""The corpus operators as queries over the synthetic tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import work_path, written
from . import boilerplate, bpe, decontamination, filter_audit, hard_negatives, merkle, mixing, sharding, simhash, suffixes, token_counts, toxicity, warc
from .common import table, words


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = simhash.with_fingerprint(docs).select("doc_id", "fp")
    out = simhash.group(prints, simhash.block_masks(3), 3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = written(table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("n_words")), "words")
    return mixing.mix(thin, size=F.col("n_words")).select("row.doc_id", "size", "source_size", "target", "copies", "taken")


OP2_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || doc_id::VARCHAR) AS h
  FROM documents),
per AS (SELECT s, sum(size)::BIGINT AS source_size FROM rows GROUP BY s),
dealt AS (SELECT s, source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT]::DOUBLE AS w,
                 (sum(source_size) OVER () * 1.5)::DOUBLE AS total, (source_size * 2)::DOUBLE AS most FROM per),
levels AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (ORDER BY most / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM dealt),
shared AS (SELECT *, max(CASE WHEN most / w > level THEN level END) OVER () AS common FROM levels),
targets AS (SELECT s, source_size, CASE WHEN most / w <= level THEN most ELSE common * w END AS target FROM shared),
placed AS (SELECT r.doc_id, r.s, r.h, r.size, t.source_size, t.target,
                  sum(r.size) OVER (PARTITION BY r.s ORDER BY r.h, r.doc_id, r.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
           FROM rows r JOIN targets t USING (s)),
times AS (SELECT doc_id, s, h, size, epoch, CASE WHEN target > 0 THEN (upto + (epoch - 1) * source_size)::DOUBLE / target ELSE 0 END AS f
          FROM placed, (VALUES (1), (2)) e(epoch) WHERE size > 0),
runs AS (SELECT doc_id, sum(size) OVER (ORDER BY f, s, h, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS run FROM times),
copies AS (SELECT doc_id, count(*) AS copies FROM runs WHERE run <= (SELECT sum(size) FROM rows) * 1.5 GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 1 ELSE coalesce(c.copies, 0) END::INT AS copies,
       (size * coalesce(c.copies, 0))::BIGINT AS taken
FROM placed LEFT JOIN copies c USING (doc_id)
"""

def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = sharding.kd_shards(docs, 8)
    return out.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("key")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_archives(spark, folder, manifest, payloads=False).drop("url")


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || substr(h, (i * 5 // 4 + 1)::INT, 2))::INT >> (3 - i * 5 % 4)::INT) & 31) + 1)::INT]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


def op7_suffix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boilerplate.strip_boilerplate(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    n = F.size("lines")
    return out.select("row.page_id", "host", n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


OP8_SQL = r"""
WITH t AS (SELECT page_id, coalesce(lower(regexp_extract(url, '@HOST', 1)), '') AS host,
                  regexp_replace(regexp_replace(regexp_replace(replace(coalesce(html, ''), chr(10), ' '), '@HIDDEN', ' ', 'g'), '@BLOCK', chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM pages),
u AS (SELECT page_id, host, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM t),
l AS (SELECT page_id, host, list_filter(list_transform(string_split(x, chr(10)), lambda y: trim(regexp_replace(y, '[\x09\x0B-\x0D\x20]+', ' ', 'g'), ' ')), lambda y: y <> '') AS lines FROM u),
n AS (SELECT host, count(*) AS pages FROM l WHERE host <> '' GROUP BY host),
c AS (SELECT host, line, count(*) AS c FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l WHERE host <> '') GROUP BY host, line),
b AS (SELECT c.host, list(line) AS bad FROM c JOIN n USING (host) WHERE c.c >= 3 AND c.c > n.pages * 0.1::DOUBLE GROUP BY c.host)
SELECT page_id, l.host, len(lines)::INT AS n_lines, (len(lines) - len(k))::INT AS n_dropped, array_to_string(k, chr(10)) AS kept_text
FROM (SELECT page_id, l.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda y: NOT list_contains(bad, y)) END AS k FROM l LEFT JOIN b ON l.host = b.host) l
""".replace("@HOST", boilerplate.HOST).replace("@HIDDEN", boilerplate.HIDDEN).replace("@BLOCK", boilerplate.BLOCK)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~toxicity.held_out("doc_id")))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_fingerprint", merkle.fingerprint(F.col("edited")))
    near = lambda c: merkle.likeness(F.col("fingerprint"), F.col(c))
    return rows.select("doc_id", n.alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS tie FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id, tie), first_value(text) OVER (ORDER BY doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text FROM d),
e AS (SELECT *, substring(text, 1, (length(text) - length(text) // 4)::INT) || substring(next_text, 1, (length(text) // 4)::INT) AS edited FROM n),
texts AS (SELECT DISTINCT x FROM (SELECT text AS x FROM e UNION ALL SELECT edited FROM e)),
tree AS (SELECT x, list_transform(regexp_extract_all(x, '@SECTION'), lambda s: list_transform(regexp_extract_all(s, '@PARAGRAPH'), lambda p:
                list_transform(regexp_extract_all(p, '@PIECE'), lambda c: md5(c)))) AS t FROM texts),
prints AS (SELECT x, sha256(array_to_string(list_transform(t, lambda s: md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), ''))), '')) AS root,
                  array_to_string(list_transform(t, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda c: c[1:8]), '')), '.')), '/') AS enc,
                  list_distinct(list_transform(flatten(flatten(t)), lambda c: c[1:8])) AS leaves FROM tree),
j AS (SELECT e.doc_id, length(e.text)::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256, a.root || ':' || a.enc AS fingerprint, b.root || ':' || b.enc AS edited_fingerprint,
             a.root AS ra, b.root AS rb, c.root AS rc, a.leaves AS la, b.leaves AS lb, c.leaves AS lc
      FROM e JOIN prints a ON a.x = e.text JOIN prints b ON b.x = e.edited JOIN prints c ON c.x = e.next_text)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN ra = rb THEN 1.0 ELSE 2.0 * len(list_intersect(la, lb)) / greatest(len(la) + len(lb), 1) END::DOUBLE AS near_edited,
       CASE WHEN ra = rc THEN 1.0 ELSE 2.0 * len(list_intersect(la, lc)) / greatest(len(la) + len(lc), 1) END::DOUBLE AS near_next
FROM j
""".replace("@SECTION", merkle.SECTION).replace("@PARAGRAPH", merkle.PARAGRAPH).replace("@PIECE", merkle.PIECE)



def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step])::INT - bits[step] AS before FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


def op13_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = bpe.read_tokenizer(tokenizer_path("word_bpe_49k.json"))
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), source), source)
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_simhash_pivots": op1_simhash_pivots,
    "op2_source_mix": op2_source_mix,
    "op3_kd_shards": op3_kd_shards,
    "op4_template_leaks": op4_template_leaks,
    "op5_token_counts": op5_token_counts,
    "op6_warc_roundtrip": op6_warc_roundtrip,
    "op7_suffix_order": op7_suffix_order,
    "op8_site_lines": op8_site_lines,
    "op9_toxicity": op9_toxicity,
    "op10_merkle_tree": op10_merkle_tree,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_bpe_roundtrip": op13_bpe_roundtrip,
}

ORACLE_SQL = {
    "op2_source_mix": OP2_SQL,
    "op6_warc_roundtrip": OP6_SQL,
    "op8_site_lines": OP8_SQL,
    "op10_merkle_tree": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
