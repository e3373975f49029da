"""The catalogue's queries in DuckDB SQL."""

from __future__ import annotations

from ..functions.text import CONFLICT_LABEL, DENIAL, DIRECTION, NEGATIONS, OG_TITLE, QUANT, STOPWORDS, STRUCTURAL, TITLE, URL_SPACE, VERDICT_LABEL
from ..operators.near_duplicates import PRIME, coefficients
from . import tables


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


def tokens(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9][a-z0-9\-\._/]*'), lambda t: trim(t, '-._/')), lambda t: length(t) >= 2 AND NOT list_contains({_list(STOPWORDS)}, t))"


def ws(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')"


BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
LINES = "string_split(replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(12), chr(10)), chr(10))"


def sentences(x: str) -> str:
    """Parts after [.!?] and white space; a mark stands in for the lookbehind."""
    return rf"list_filter(string_split(regexp_replace({x}, '([.!?])[ \t\n\r\f\x0b]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, {BLANK}) <> '')"


def bound(x: str) -> str:
    """Sentences with citations that open a part moved to the end of the one before."""
    return sentences(rf"regexp_replace({x}, '([.!?])[ \t]+((?:\[S\d+\][ \t]*)+)', '\1' || chr(3) || '\2' || chr(2), 'g')")


SNAP = "snap AS (SELECT doc_id, sha256(text) AS content_hash, source AS source_id, text, lang, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS published_at FROM documents)"
REG = """reg AS (SELECT source AS source_id, n % 3 + 1 AS tier, 't' || n % 2 AS tag, 'g' || n // 4 AS independence_group, CASE WHEN n % 10 = 9 THEN 'paused' ELSE 'active' END AS status
        FROM (SELECT DISTINCT source, regexp_extract(source, '(\\d+)$', 1)::INT AS n FROM documents))"""
POLLS = "polls AS (SELECT user_id::VARCHAR AS source_id, event_id, ts AS started_at, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, floor(value)::BIGINT AS items_seen, CASE WHEN event_type = 'error' THEN props END AS error FROM events)"
NETLOC = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"
HEALTH = f"""WITH {POLLS},
ok AS (SELECT source_id, max(struct_pack(t := started_at, e := event_id)) FILTER (status <> 'error') AS k FROM polls GROUP BY 1),
h AS (SELECT p.source_id, count(*) FILTER (status = 'error' AND (k IS NULL OR struct_pack(t := started_at, e := event_id) > k)) AS consecutive_failures,
       arg_max(status, struct_pack(t := started_at, e := event_id)) AS last_status, any_value(k.t) AS last_ok_at,
       count(*) FILTER (started_at >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR) AS events_in_window,
       coalesce(sum(items_seen) FILTER (started_at >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR), 0)::BIGINT AS items_in_window, 0::BIGINT AS new_in_window,
       arg_max(error, struct_pack(t := started_at, e := event_id)) FILTER (error <> '') AS last_error
      FROM polls p JOIN ok USING (source_id) GROUP BY p.source_id),
health AS (SELECT source_id, CASE WHEN consecutive_failures = 0 THEN 'ok' WHEN consecutive_failures < 3 THEN 'degraded' ELSE 'failing' END AS status,
       last_status, last_ok_at, consecutive_failures, events_in_window, items_in_window, new_in_window, last_error FROM h)"""
#: Distinct texts with their shingles, similar pairs and clusters.
PAIRS = f"""texts AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
toks AS (SELECT id, {tokens('text')} AS t FROM texts),
shing AS (SELECT id, list_distinct(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: array_to_string(t[i:i + 4], ' '))) AS s FROM toks WHERE len(t) > 0),
flat AS (SELECT id, unnest(s) AS h FROM shing),
common AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM flat x JOIN flat y ON x.h = y.h AND x.id < y.id GROUP BY 1, 2),
pairs AS (SELECT a, b, n / (len(p.s) + len(q.s) - n)::DOUBLE AS jaccard FROM common JOIN shing p ON p.id = a JOIN shing q ON q.id = b WHERE n / (len(p.s) + len(q.s) - n)::DOUBLE >= 0.8)"""

#: Texts with their signatures.
SIGNED = f"""{PAIRS.split('flat AS')[0].rstrip().rstrip(',')},
hashed AS (SELECT id, list_transform(s, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM shing),
signed AS (SELECT id, list_transform([{', '.join(f"{{a: {a}::BIGINT, b: {b}::BIGINT}}" for a, b in coefficients())}], lambda c: list_min(list_transform(h, lambda x: (x * c.a + c.b) % {PRIME}))) AS m FROM hashed)"""


def reach(edges: str) -> str:
    """(node, root) of the nodes of edges (a, b): the least node that each reaches."""
    return f"""paired AS (SELECT a AS x, b AS y FROM {edges} UNION SELECT b, a FROM {edges}),
reach AS (SELECT x AS node, x AS r FROM paired UNION SELECT paired.y, reach.r FROM reach JOIN paired ON paired.x = reach.node),
roots AS (SELECT node, min(r) AS root FROM reach GROUP BY node)"""


CLUSTERS = f"{PAIRS}, {reach('pairs')}, clustered AS (SELECT d.doc_id, coalesce(root, t.id) AS root FROM documents d JOIN texts t USING (text) LEFT JOIN roots ON node = t.id)"
STORIES = f"""WITH RECURSIVE {SNAP}, {CLUSTERS},
c AS (SELECT s.*, root::VARCHAR AS story, lpad(doc_id::VARCHAR, 12, '0') AS chunk_id FROM snap s JOIN clustered USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY published_at DESC, chunk_id DESC) AS position, max(published_at) OVER (PARTITION BY story) AS newest FROM c),
heads AS (SELECT story, newest, substring({LINES.format(f"trim(text, ' ')")}[1], 1, 90) AS headline FROM r WHERE position = 1 ORDER BY newest DESC, story LIMIT 20)"""
EVIDENCE_IDS = "SELECT 'S' || row_number() OVER (ORDER BY h.newest DESC, h.story, position) AS sid, h.story, headline, doc_id, position::INT AS position FROM r JOIN heads h USING (story) WHERE position <= 3"


def post(name: str, rows: str) -> str:
    """Postings of (id, text) rows."""
    return f"""{name}_t AS (SELECT id, {tokens('text')} AS t FROM ({rows})), {name}_c AS (SELECT id, len(t) AS n, unnest(t) AS token FROM {name}_t),
{name}_f AS (SELECT id, n, token, count(*) AS tf FROM {name}_c GROUP BY ALL),
{name} AS (SELECT id, ('0x' || substr(md5(token), 1, 8))::BIGINT AS idx, sum(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / 400))) AS weight FROM {name}_f GROUP BY 1, 2)"""


DOCS, ITEMS = "SELECT doc_id AS id, text FROM documents", "SELECT item_id AS id, text FROM benchmark"


def sparse(k: int) -> str:
    return f"""{post('dp', DOCS)}, {post('qp', ITEMS)},
idf AS (SELECT idx, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM dp GROUP BY idx),
ss AS (SELECT q.id AS query_id, p.id, round(sum(q.weight * idf * p.weight), 9) AS score FROM qp q JOIN idf USING (idx) JOIN dp p USING (idx) GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ss) WHERE rank <= {k})"""


def vec(name: str, rows: str) -> str:
    """Normalised hashing embeddings of (id, text) rows, non-zero places."""
    return f"""{name}_t AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS t FROM ({rows})),
{name}_s AS (SELECT id, (('0x' || substr(md5(t), 1, 8))::BIGINT % 256)::INT AS bucket, sum(CASE WHEN ('0x' || substr(md5(t), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM {name}_t GROUP BY 1, 2),
{name} AS (SELECT s.id, bucket, v / norm AS value FROM {name}_s s JOIN (SELECT id, sqrt(sum(v * v)::DOUBLE) AS norm FROM {name}_s GROUP BY id) n ON s.id = n.id WHERE v <> 0)"""


def dense(k: int) -> str:
    return f"""{vec('dv', DOCS)}, {vec('qv', ITEMS)},
ds AS (SELECT q.id AS query_id, d.id, sum(q.value * d.value) AS c FROM qv q JOIN dv d USING (bucket) GROUP BY 1, 2),
da AS (SELECT q.item_id AS query_id, d.doc_id AS id, round(coalesce(c, 0.0), 9) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN ds ON ds.query_id = q.item_id AND ds.id = d.doc_id),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM da) WHERE rank <= {k})"""


CLAIMS = f"""lined AS (SELECT conv_id, turn, unnest(ls) AS l, unnest(range(len(ls))) AS line FROM (SELECT conv_id, turn, {LINES.format("coalesce(text, '')")} AS ls FROM conversations)),
sents AS (SELECT conv_id, turn, line, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM (SELECT *, {sentences(f'trim(l, {BLANK})')} AS ss FROM lined)),
own AS (SELECT ((conv_id * 1000 + turn) * 1048576 + line) * 4096 + pos AS id, {ws('s')} AS claim, 'c' || conv_id % 20 AS source_id, 'v' || conv_id AS cluster_id, conv_id % 3 + 1 AS tier FROM sents),
told AS (SELECT -10 + row_number() OVER (ORDER BY sid) - 1 AS id, claim, source_id, cluster_id, tier FROM (VALUES {_values(tables.GOLDEN)}) g(sid, source_id, tier, cluster_id, claim)),
claims AS (SELECT *, CASE WHEN regexp_matches(claim, '{DENIAL}') THEN 'denied' ELSE 'asserted' END AS modality, source_id AS independence_group, 'S' || (id + 10) AS sid
           FROM (SELECT * FROM own WHERE length(claim) >= 25 AND NOT regexp_matches(claim, '{QUANT}') UNION ALL SELECT * FROM told))"""
EVENT_PAIRS = f"""firsts AS (SELECT claim, min(id) AS id FROM claims GROUP BY claim),
sets AS (SELECT id, claim, list_distinct(list_filter({tokens('claim')}, lambda t: NOT list_contains({_list(NEGATIONS)}, t))) AS s FROM firsts),
members AS (SELECT id, unnest(s) AS h FROM sets),
met AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM members x JOIN members y ON x.h = y.h AND x.id < y.id GROUP BY 1, 2),
epairs AS (SELECT a, b, n / (len(p.s) + len(q.s) - n)::DOUBLE AS jaccard FROM met JOIN sets p ON p.id = a JOIN sets q ON q.id = b WHERE n / (len(p.s) + len(q.s) - n)::DOUBLE >= 0.5)"""
GROUPS = f"{EVENT_PAIRS}, {reach('epairs')}, groups AS (SELECT c.id, CASE WHEN len(s.s) > 0 THEN coalesce(root, s.id) ELSE c.id END AS root FROM claims c JOIN sets s USING (claim) LEFT JOIN roots ON node = s.id)"


def voices(rows: str, pre: str = "v") -> str:
    """(claim_group, independent_voices, tier1_voices) of rows (id, claim_group, cluster_id, independence_group, tier)."""
    return f"""{pre}_e AS (SELECT a.claim_group, a.id AS x, b.id AS y FROM {rows} a JOIN {rows} b ON a.claim_group = b.claim_group AND (a.cluster_id = b.cluster_id OR (a.independence_group = b.independence_group AND a.independence_group <> ''))),
{pre}_r AS (SELECT claim_group, id, id AS r FROM {rows} UNION SELECT e.claim_group, e.y, q.r FROM {pre}_r q JOIN {pre}_e e ON e.x = q.id AND e.claim_group = q.claim_group),
{pre}_m AS (SELECT claim_group, id, min(r) AS root FROM {pre}_r GROUP BY ALL),
{pre} AS (SELECT m.claim_group, count(DISTINCT root) AS independent_voices, count(DISTINCT root) FILTER (tier = 1) AS tier1_voices FROM {pre}_m m JOIN {rows} e USING (claim_group, id) GROUP BY 1)"""


RULE = "CASE WHEN {0} THEN 'contradicted' WHEN independent_voices >= 2 AND tier1_voices >= 1 THEN 'confirmed' ELSE 'attributed' END AS verdict"
EVENTS = f"""{CLAIMS}, {GROUPS}, ev AS (SELECT c.*, root AS claim_group FROM claims c JOIN groups USING (id)), {voices('ev')},
eg AS (SELECT claim_group, arg_min(claim, id) AS any_, arg_min(claim, id) FILTER (modality = 'asserted') AS asserted, count(DISTINCT modality) = 2 AS both_,
  'asserted by ' || coalesce(string_agg(DISTINCT source_id, ', ' ORDER BY source_id) FILTER (modality = 'asserted'), '') || '; denied by ' || coalesce(string_agg(DISTINCT source_id, ', ' ORDER BY source_id) FILTER (modality = 'denied'), '') AS told,
  list_sort(list(DISTINCT source_id)) AS sources, list_transform(list_sort(list(DISTINCT substr(sid, 2)::BIGINT)), lambda n: 'S' || n) AS sids, arg_min(cluster_id, id) AS story_cluster FROM ev GROUP BY claim_group),
events_out AS (SELECT claim_group, CASE WHEN both_ THEN asserted ELSE any_ END AS text, {RULE.format('both_')}, independent_voices, tier1_voices, sources, sids, story_cluster, CASE WHEN both_ THEN told END AS conflict, false AS dropped FROM eg JOIN v USING (claim_group))"""
#: Value groups by anchors: for ascending values the next anchor is the first value out of reach of the last.
QUANTS = """q AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'tax ' || l_orderkey || '/' || l_linenumber AS claim, 'p' || l_partkey AS entity_id, l_tax AS value,
   year(l_shipdate) || '-' || lpad(quarter(l_shipdate)::VARCHAR, 2, '0') || '-01' AS as_of, 's' || l_suppkey AS source_id, 'g' || l_suppkey // 4 AS independence_group, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 2 END AS tier FROM lineitem),
anchors AS (SELECT entity_id, as_of, min(value) AS anchor FROM q GROUP BY 1, 2 UNION SELECT q.entity_id, q.as_of, min(q.value) FROM anchors a JOIN q ON q.entity_id = a.entity_id AND q.as_of = a.as_of AND abs(a.anchor - q.value) > 0.015 AND q.value > a.anchor GROUP BY q.entity_id, q.as_of),
member AS (SELECT q.entity_id, q.as_of, q.source_id, max(anchor) AS anchor, q.id FROM q JOIN anchors a ON a.entity_id = q.entity_id AND a.as_of = q.as_of AND a.anchor <= q.value GROUP BY ALL),
described AS (SELECT entity_id, as_of, anchor, anchor::VARCHAR || ' rate (' || string_agg(DISTINCT source_id, ', ' ORDER BY source_id) || ')' AS told FROM member GROUP BY 1, 2, 3),
conflicts AS (SELECT entity_id, as_of, count(*) > 1 AS many, 'conflicting values: ' || string_agg(told, ' vs ' ORDER BY anchor) AS told FROM described GROUP BY 1, 2),
-- without clusters, one claim's voices are its independence groups
qg AS (SELECT entity_id, as_of, arg_min(claim, id) AS first, arg_min(claim, value * 100 * 1e10 + id) AS least, list_sort(list(DISTINCT source_id)) AS sources, count(DISTINCT independence_group) AS independent_voices, count(DISTINCT independence_group) FILTER (tier = 1) AS tier1_voices FROM q GROUP BY 1, 2),
quants_out AS (SELECT entity_id, as_of, CASE WHEN many THEN least ELSE first END AS text, """ + RULE.format("many") + """, independent_voices, tier1_voices, sources, CASE WHEN many THEN told END AS conflict, false AS dropped FROM qg JOIN conflicts USING (entity_id, as_of))"""
BODIES = rf"""b_t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x0b]+', ' ', 'g') || ' [S' || (turn + 1) || '][S' || (turn + 2) || ']' AS x FROM conversations),
bodies AS (SELECT conv_id AS body_id, '# Conversation' || chr(10) || string_agg(x, chr(10) ORDER BY turn, x) AS body FROM b_t GROUP BY 1),
evidence AS (SELECT conv_id AS body_id, 'S' || (turn + 1) AS sid, coalesce(text, '') AS text FROM conversations)"""
CHECKS = rf"""{BODIES},
bl AS (SELECT body_id, unnest(ls) AS l, unnest(range(len(ls))) AS line FROM (SELECT body_id, string_split(body, chr(10)) AS ls FROM bodies)),
bs AS (SELECT body_id, line, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM (SELECT body_id, line, list_transform({bound(f'trim(l, {BLANK})')}, lambda s: trim(replace(replace(s, chr(2), ''), chr(3), ' '), ' ')) AS ss FROM bl WHERE trim(l, {BLANK}) <> '' AND NOT regexp_matches(trim(l, ' '), '{STRUCTURAL}'))),
bc AS (SELECT *, list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(s, '\[S(\d+)\]', 1), lambda x: x::BIGINT))), lambda n: 'S' || n) AS sids FROM bs),
pool AS (SELECT body_id, line, pos, flatten(list({tokens('text')})) AS p FROM (SELECT body_id, line, pos, unnest(sids) AS sid FROM bc) JOIN evidence USING (body_id, sid) GROUP BY 1, 2, 3),
bt AS (SELECT bc.*, list_distinct({tokens(rf"regexp_replace(regexp_replace(regexp_replace(s, '{CONFLICT_LABEL}', '', 'g'), '{VERDICT_LABEL}', '', 'g'), '\[S\d+\]', '', 'g')")}) AS t, coalesce(p, []) AS p FROM bc LEFT JOIN pool USING (body_id, line, pos)),
checks AS (SELECT body_id, line::INT AS line, pos::INT AS pos, s AS sentence, sids, len(sids) > 0 AND (len(t) = 0 OR len(list_intersect(t, p)) / len(t)::DOUBLE >= 0.5) AS supported FROM bt)"""
FORMS = sorted({s for s, _, _ in tables.DICTIONARY}, key=lambda s: (-len(s), s))
CANONICAL: dict[str, str] = {}
SURFACES: dict[str, list[str]] = {}
for _s, _c, _ in tables.DICTIONARY:
    CANONICAL.setdefault(_s.lower(), _c)
    SURFACES.setdefault(_c, []).append(_s)


def tags(x: str) -> str:
    found = f"list_transform(regexp_extract_all(coalesce({x}, ''), '(?i)\\b(?:{'|'.join(FORMS)})\\b'), lambda s: lower(s))"
    return f"list_sort(list_distinct(list_transform({found}, lambda s: MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in CANONICAL.items())}}}[s])))"


_FORMS_OF = "MAP {" + ", ".join(f"{k!r}: {_list(v)}" for k, v in SURFACES.items()) + "}"

ORACLE_SQL = {
    "registry_scope": f"WITH {REG} SELECT source_id, tier, independence_group FROM reg WHERE status = 'active' AND tag = 't0' AND tier <= 2",
    "snapshot_put_dedup": f"WITH {SNAP} SELECT content_hash, arg_min(source_id, doc_id) AS source_id, min(doc_id) AS doc_id, substr(content_hash, 1, 2) || '/' || content_hash AS blob_uri FROM snap GROUP BY content_hash",
    "snapshot_sightings": f"WITH {SNAP} SELECT content_hash, source_id, min(doc_id) AS first_seen, count(*) AS times FROM snap GROUP BY 1, 2",
    "poll_watermark_filter": f"WITH {POLLS}, m AS (SELECT source_id, max(started_at) AS since FROM polls WHERE started_at < '2024-01-15' AND status <> 'error' GROUP BY 1) SELECT source_id, count(*) AS n, sum(items_seen)::BIGINT AS items FROM polls LEFT JOIN m USING (source_id) WHERE since IS NULL OR started_at > since GROUP BY 1",
    "poll_totals": f"WITH {POLLS} SELECT sum(items_seen)::BIGINT AS items_seen, 0::BIGINT AS snapshots_new, sum(items_seen)::BIGINT AS snapshots_dup FROM polls",
    "source_health": HEALTH + " SELECT * FROM health",
    "overview_counts": HEALTH + f""", cand AS (SELECT DISTINCT netloc FROM (SELECT {NETLOC.format('url')} AS netloc FROM pages) WHERE netloc <> '' AND netloc NOT IN (SELECT {NETLOC.format('url')} FROM pages WHERE url LIKE 'https://m.%') AND netloc NOT IN (SELECT {NETLOC.format('url')} FROM pages WHERE url LIKE '%//blog.%'))
        SELECT 'snapshots' AS name, count(*) AS n FROM documents UNION ALL SELECT 'runs', count(*) FROM events UNION ALL SELECT 'pending_candidates', count(*) FROM cand UNION ALL SELECT 'sources_' || status, count(*) FROM health GROUP BY 1""",
    "extract_strip_html": r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ') AS text FROM pages",
    "page_title_netloc": rf"""SELECT page_id, nullif(trim(CASE WHEN regexp_extract(html, '{OG_TITLE.replace("'", "''")}', 1) <> '' THEN regexp_extract(html, '{OG_TITLE.replace("'", "''")}', 1) ELSE regexp_extract(html, '{TITLE}', 1) END, {BLANK}), '') AS title, {NETLOC.format('url')} AS netloc, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url_key FROM pages""",
    "candidates_propose": f"""WITH l AS (SELECT *, {NETLOC.format('url')} AS netloc FROM pages) SELECT netloc, arg_min(url, page_id) AS url, count(*) AS links, translate(netloc, '.-', '__') AS stub_id, 'pending' AS status FROM l
        WHERE netloc <> '' AND netloc NOT IN (SELECT netloc FROM l WHERE url LIKE 'https://m.%') AND netloc NOT IN (SELECT netloc FROM l WHERE url LIKE '%//blog.%') GROUP BY netloc""",
    "tokenize_counts": f"WITH x AS (SELECT doc_id, {tokens('text')} AS t FROM documents) SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM x",
    "bm25_weights": f"WITH {post('dp', DOCS)} SELECT id, idx, round(weight, 6) AS weight FROM dp",
    "hashing_embedding": f"WITH {vec('dv', DOCS)} SELECT id, bucket, round(value, 6) AS value FROM dv",
    "entity_tags": f"SELECT doc_id, {tags('text')} AS entity_ids FROM documents",
    "query_expand": f"WITH e AS (SELECT conv_id, turn, text, {tags('text')} AS ids FROM conversations), x AS (SELECT *, list_sort(list_distinct(list_concat(ids, flatten(list_transform(ids, lambda i: {_FORMS_OF}[i]))))) AS extra FROM e) SELECT conv_id, turn, CASE WHEN len(extra) = 0 THEN text ELSE text || ' ' || array_to_string(extra, ' ') END AS expanded FROM x",
    "near_dup_exact": f"WITH {PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs",
    "minhash_lsh_candidates": f"WITH {PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs",
    "minhash_signatures": f"WITH {SIGNED} SELECT id, md5(array_to_string(m, ',')) AS signature FROM signed",
    "story_clusters": f"WITH RECURSIVE {CLUSTERS} SELECT doc_id, root FROM clustered",
    "dense_topk": """WITH n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
        c AS (SELECT q.id AS query_id, d.id, round(list_dot_product(q.v, d.v) / (q.n * d.n), 9) AS score FROM n q CROSS JOIN n d WHERE q.id % 20 = 0)
        SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= 10""",
    "sparse_topk": f"WITH {sparse(10)} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM sparse",
    "hybrid_rrf": f"""WITH {sparse(96)}, {dense(96)}, u AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM sparse) GROUP BY 1, 2)
        SELECT query_id, id, round(score, 9) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM u) WHERE rank <= 24""",
    "retrieve_scoped_window": f"""WITH {SNAP}, {REG} SELECT doc_id, source_id, tier, independence_group FROM snap JOIN reg USING (source_id) WHERE status = 'active' AND tier <= 2 AND published_at >= TIMESTAMP '2024-01-01 16:00:00' - INTERVAL 24 HOUR
        ORDER BY published_at DESC, content_hash || ':' || doc_id LIMIT 500""",
    "coverage_gate": f"""WITH {dense(24)}, qt AS (SELECT item_id, {tokens('text')} AS t FROM benchmark), dt AS (SELECT doc_id, {tokens('text')} AS t FROM documents),
        k AS (SELECT query_id, count(*) AS hits FROM dense JOIN qt ON item_id = query_id JOIN dt ON doc_id = id WHERE list_has_any(qt.t, dt.t) GROUP BY 1) SELECT item_id AS query_id, coalesce(hits, 0) AS hits FROM benchmark LEFT JOIN k ON query_id = item_id""",
    "best_score_assemble": f"""WITH {sparse(24)}, b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, query_id) AS r FROM sparse), o AS (SELECT id, query_id, score, row_number() OVER (ORDER BY score DESC, id) AS n FROM b WHERE r = 1)
        SELECT id, query_id, round(score, 6) AS score, 'S' || n AS sid FROM o WHERE n <= 40""",
    "build_stories": f"{STORIES} {EVIDENCE_IDS}",
    "split_sentences": f"""WITH l AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS line FROM (SELECT doc_id, {LINES.format("coalesce(text, '')")} AS ls FROM documents)),
        s AS (SELECT doc_id, line, {sentences(f'trim(l, {BLANK})')} AS ss FROM l) SELECT doc_id, line::INT AS line, unnest(range(len(ss)))::INT AS pos, unnest(ss) AS sentence FROM s""",
    "claims_event": f"WITH {CLAIMS} SELECT id, claim, modality, source_id FROM claims",
    "claims_quant": rf"""WITH r(id, s, day) AS (SELECT l_orderkey * 10 + l_linenumber, CASE (l_orderkey * 10 + l_linenumber) % 5 WHEN 0 THEN 'War risk premiums rose to ' || q || '.5 percent in the strait.' WHEN 1 THEN 'Crude prices climbed to $' || q || ' per barrel in early trading.'
            WHEN 2 THEN 'Output fell to ' || q || ',000 barrels, the note said.' WHEN 3 THEN 'The refinery closes for maintenance in week ' || q || '.' ELSE 'The rate reached ' || q || ' % while production declined at 9.1 mb/d.' END, strftime(l_shipdate, '%Y-%m-%d') FROM (SELECT *, l_quantity::INT::VARCHAR AS q FROM lineitem)
          UNION ALL SELECT -doc_id - 1, {ws('text')}, '2024-03-05' FROM documents),
        p AS (SELECT id, day, unnest({sentences('s')}) AS s FROM r), q AS (SELECT id, day, {ws('s')} AS s FROM p)
        SELECT id, s AS claim, lower(regexp_extract(s, '{QUANT}', 1)) AS entity_id, rtrim(lower(regexp_extract(s, '{QUANT}', 1)), 's') AS metric, regexp_extract(s, '{QUANT}', 2)::DOUBLE AS value, nullif(lower(regexp_extract(s, '{QUANT}', 3)), '') AS unit, day AS as_of,
        nullif(lower(regexp_extract(s, '{DIRECTION}', 1)), '') AS direction FROM q WHERE length(s) >= 25 AND regexp_matches(s, '{QUANT}')""",
    "event_match_pairs": f"WITH {CLAIMS}, {EVENT_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard, false AS copy FROM epairs UNION ALL SELECT f.id, c.id, 1, true FROM claims c JOIN sets f USING (claim) WHERE len(f.s) > 0 AND c.id <> f.id",
    "event_groups": f"WITH RECURSIVE {CLAIMS}, {GROUPS} SELECT id, root FROM groups",
    "voices": f"WITH RECURSIVE {SNAP}, {REG}, ve AS (SELECT doc_id AS id, lang || ':' || doc_id // 40 AS claim_group, content_hash AS cluster_id, independence_group, tier FROM snap JOIN reg USING (source_id)), {voices('ve')} SELECT * FROM v",
    "corroborate_events": f"WITH RECURSIVE {EVENTS} SELECT * FROM events_out",
    "corroborate_quants": f"WITH RECURSIVE {QUANTS} SELECT * FROM quants_out",
    "verdict_counts": f"WITH RECURSIVE {EVENTS}, {QUANTS} SELECT verdict, count(*) AS n FROM (SELECT verdict FROM events_out UNION ALL SELECT verdict FROM quants_out) GROUP BY 1",
    "validate_citations": rf"""WITH {BODIES}, known AS (SELECT DISTINCT body_id, sid FROM evidence),
        cl AS (SELECT conv_id, turn, x, substr(x, 1, length(x) - length('[S' || (turn + 1) || '][S' || (turn + 2) || ']')) || CASE WHEN (conv_id, 'S' || (turn + 1)) IN (SELECT (body_id, sid) FROM known) THEN '[S' || (turn + 1) || ']' ELSE '' END || CASE WHEN (conv_id, 'S' || (turn + 2)) IN (SELECT (body_id, sid) FROM known) THEN '[S' || (turn + 2) || ']' ELSE '' END AS y FROM b_t),
        cb AS (SELECT conv_id AS body_id, trim('# Conversation' || chr(10) || string_agg(y, chr(10) ORDER BY turn, x), {BLANK}) AS cleaned, sum(len(regexp_extract_all(x, '\[S\d+\]')) - len(regexp_extract_all(y, '\[S\d+\]')))::BIGINT AS invalid FROM cl GROUP BY 1),
        un AS (SELECT conv_id AS body_id, sum(len(list_filter({bound(f'trim(y, {BLANK})')}, lambda s: NOT regexp_matches(s, '\[S\d+\]'))))::INT AS uncited FROM cl GROUP BY 1)
        SELECT body_id, cleaned, list_transform(list_sort(list_distinct(list_transform(regexp_extract_all(cleaned, '\[S(\d+)\]', 1), lambda x: x::BIGINT))), lambda n: 'S' || n) AS cited, uncited, invalid FROM cb JOIN un USING (body_id)""",
    "drop_unsupported": f"""WITH {CHECKS}, bad AS (SELECT DISTINCT body_id, sentence FROM checks WHERE NOT supported),
        k AS (SELECT body_id, line, string_agg(sentence, ' ' ORDER BY pos) FILTER ((body_id, sentence) NOT IN (SELECT (body_id, sentence) FROM bad)) AS kept, count(*) FILTER ((body_id, sentence) IN (SELECT (body_id, sentence) FROM bad)) AS n FROM checks GROUP BY 1, 2)
        SELECT body_id, CASE WHEN sum(n) > 0 THEN trim('# Conversation' || coalesce(string_agg(chr(10) || kept, '' ORDER BY line), ''), {BLANK}) ELSE any_value(body) END AS shipped, sum(n)::INT AS n_dropped FROM k JOIN bodies USING (body_id) GROUP BY 1""",
    "verify_sentences": f"WITH {CHECKS} SELECT body_id, line, pos, sentence, sids, supported FROM checks",
    "verify_precision": f"WITH {CHECKS} SELECT body_id, count(*) AS checked, count(*) FILTER (NOT supported) AS failed, count(*) FILTER (supported) / count(*)::DOUBLE AS precision FROM checks GROUP BY 1",
    "golden_pass_rate": """WITH m AS (SELECT source AS c, text, quality FROM documents JOIN labels USING (doc_id)), w AS (SELECT DISTINCT source AS c, text AS needle FROM documents JOIN labels USING (doc_id)),
        o AS (SELECT w.c, w.needle, coalesce(bool_and(quality = 1), false) AS passed FROM w LEFT JOIN m ON m.c = w.c AND contains(lower(m.text), lower(w.needle)) GROUP BY 1, 2) SELECT c AS "case", count(*) AS expectations, count(*) FILTER (passed) AS passed FROM o GROUP BY 1""",
    "snapshot_search": "SELECT doc_id, source AS source_id, text AS title FROM documents WHERE text ILIKE '%THE%' ORDER BY doc_id DESC LIMIT 50",
    "replay_equivalence": f"WITH RECURSIVE {EVENTS} SELECT verdict, count(*) AS n, count(*) AS again, 0::BIGINT AS differing FROM events_out GROUP BY 1".replace("conv_id % 3 + 1 AS tier", "(conv_id % 20) % 3 + 1 AS tier"),
    "stream_health_window": f"WITH {POLLS} SELECT source_id, date_trunc('day', started_at)::TIMESTAMP AS day, count(*) AS polls, count(*) FILTER (status = 'error') AS failed, sum(items_seen)::BIGINT AS items FROM polls GROUP BY 1, 2",
    "stream_put_dedup": f"WITH {SNAP} SELECT content_hash, arg_min(source_id, doc_id) AS source_id, min(doc_id) AS doc_id FROM snap GROUP BY content_hash",
    "point_ids": f"""WITH h AS (SELECT doc_id, sha1(unhex('{URL_SPACE}') || encode('chunk:' || sha256(text) || ':0')) AS h FROM documents)
        SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
    "index_upsert": "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'second' ELSE 'first' END AS label, len(embedding)::INT AS dimension FROM embeddings",
    "extract_media": f"""WITH x AS (SELECT doc_id, doc_id % 5 AS n, trim(' ' || coalesce(text, '') || chr(10), {BLANK}) AS t FROM documents)
        SELECT doc_id, CASE WHEN n = 4 THEN 'unsupported' WHEN n = 2 THEN 'failed' WHEN n <> 1 AND t = '' THEN 'empty' ELSE 'ok' END AS extraction_status,
        CASE WHEN n IN (2, 4) THEN '' WHEN n = 1 THEN '{{' || chr(10) || ' "id": ' || doc_id || ',' || chr(10) || ' "tags": [' || chr(10) || '  "a"' || chr(10) || ' ]' || chr(10) || '}}' ELSE t END AS text FROM x""",
    "robots_permitted": f"SELECT page_id FROM (SELECT page_id, {NETLOC.format('url')} AS netloc FROM pages) WHERE page_id % 3 = 2 OR netloc = '' OR (page_id % 3 = 0 AND page_id::VARCHAR LIKE '1%')",
    "sitemap_pages": f"SELECT DISTINCT regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS url, TIMESTAMP '2024-01-02' AS lastmod FROM pages WHERE {NETLOC.format('url')} <> '' AND NOT regexp_matches(url, '(?i)/blog')",
    "signature_clusters": f"""WITH RECURSIVE {SIGNED}, banded AS (SELECT id, unnest(range(32)) AS b, m FROM signed), keyed AS (SELECT id, b, m[b * 4 + 1:b * 4 + 4] AS k, m FROM banded),
        near AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keyed x JOIN keyed y ON x.b = y.b AND x.k = y.k AND x.id < y.id WHERE len(list_filter(range(1, 129), lambda i: x.m[i] = y.m[i])) >= 128 * 0.8),
        {reach('near')}, g AS (SELECT t.id, coalesce(root, t.id) AS root FROM texts t LEFT JOIN roots ON node = t.id),
        f AS (SELECT root, arg_min(id, id % 2 * 10000000000 + id) AS first FROM g GROUP BY root) SELECT id, id <> first AS joined FROM g JOIN f USING (root)""",
    "poll_loop": """WITH s AS (SELECT DISTINCT source FROM documents WHERE regexp_extract(source, '(\\d+)$', 1)::INT % 10 <> 9),
        d AS (SELECT source, doc_id, coalesce(text, '') AS t, doc_id % 2 AS r FROM documents WHERE source IN (SELECT source FROM s) AND source <> 'src1'),
        f AS (SELECT t, arg_min(source, struct_pack(r := r, s := source)) AS source FROM d GROUP BY t),
        seen AS (SELECT source, count(*) FILTER (r = 0) + count(*) AS n FROM d GROUP BY 1), new AS (SELECT source, count(*) AS n FROM f GROUP BY 1)
        SELECT source AS source_id, CASE WHEN source = 'src1' THEN 'error' ELSE 'ok' END AS status, 2::BIGINT AS polls,
        coalesce(seen.n, 0)::BIGINT AS items_seen, coalesce(new.n, 0)::BIGINT AS snapshots_new,
        (coalesce(seen.n, 0) - coalesce(new.n, 0))::BIGINT AS snapshots_dup FROM s LEFT JOIN seen USING (source) LEFT JOIN new USING (source)""",
    "brief_body": rf"""WITH RECURSIVE {EVENTS}, told_lines AS (SELECT claim_group, coalesce(story_cluster, '') AS story, sids, regexp_replace({ws('text')}, '\.+$', '') || ' (' || CASE verdict WHEN 'confirmed' THEN 'confirmed by ' || independent_voices || ' independent source' || CASE WHEN independent_voices <> 1 THEN 's' ELSE '' END
            WHEN 'attributed' THEN 'reported by ' || array_to_string(sources, ', ') || ', unconfirmed' WHEN 'contradicted' THEN 'CONFLICTING REPORTS — ' || coalesce(conflict, 'sources disagree') ELSE 'unverified' END || '). ' || array_to_string(list_transform(sids, lambda x: '[' || x || ']'), '') AS out FROM events_out WHERE len(sids) > 1 AND NOT dropped),
        cited AS (SELECT story, claim_group, unnest(sids) AS sid, unnest(range(len(sids))) AS i FROM told_lines),
        heads AS (SELECT story, arg_min(substring(string_split(claim, chr(10))[1], 1, 90), struct_pack(g := claim_group, i := i)) AS head FROM cited JOIN claims USING (sid) GROUP BY story),
        parts AS (SELECT story, min(claim_group) AS first, string_agg(out, chr(10) ORDER BY claim_group) AS body FROM told_lines GROUP BY story)
        SELECT 1::INT AS body_id, string_agg('### ' || coalesce(head, nullif(story, ''), 'Untitled') || chr(10) || body, chr(10) || chr(10) ORDER BY first) AS body FROM parts LEFT JOIN heads USING (story)""",
    "tag_gap_sets": f"WITH {REG} SELECT tag FROM (VALUES ('t0'), ('t1'), ('t2'), ('general')) w(tag) WHERE tag NOT IN (SELECT tag FROM reg)",
    "graph_components": f"WITH RECURSIVE {SNAP}, f AS (SELECT content_hash, min(doc_id) AS a FROM snap GROUP BY 1), e AS (SELECT a, doc_id AS b FROM snap JOIN f USING (content_hash) WHERE a < doc_id), {reach('e')} SELECT node, root FROM roots",
    "ingest_stats": f"WITH RECURSIVE {CLUSTERS} SELECT CASE WHEN length(text) < 400 THEN 'empty' ELSE 'extracted' END AS extraction_status, count(*) AS n, count(*) FILTER (sha256(d.text) <> (SELECT any_value(sha256(r.text)) FROM documents r WHERE r.doc_id = c.root)) AS clusters_joined FROM documents d JOIN clustered c USING (doc_id) GROUP BY 1",
}
