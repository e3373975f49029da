"""The further queries in DuckDB SQL."""

from __future__ import annotations

from ..operators.chunking import BLANK, OVERLAP, SEPARATORS, SIZE
from .catalog_sql import EVENTS, HEALTH, NETLOC, PAIRS, QUANTS, SIGNED, reach, sparse, ws


def _level(items: str, separator: str) -> str:
    mark = separator.replace("\n", "'||chr(10)||'")
    end = "[{'kind': 2, 'text': ''}]"
    parts = f"list_filter(list_transform(string_split(x.text, '{mark}'), lambda p, i: CASE WHEN i = 1 THEN p ELSE '{mark}' || p END), lambda p: p <> '')"
    inner = f"list_transform({parts}, lambda p: {{'kind': CASE WHEN length(p) >= {SIZE} THEN 1 ELSE 0 END, 'text': p}})"
    return f"flatten(list_transform({items}, lambda x: CASE WHEN x.kind = 1 AND contains(x.text, '{mark}') THEN {end} || {inner} || {end} ELSE [x] END))"


def _chunks() -> str:
    steps, items = [], "[{'kind': 1, 'text': t}]"
    for n, separator in enumerate(SEPARATORS):
        steps.append(f"l{n} AS (SELECT doc_id, {_level(items, separator)} AS items FROM {'long' if n == 0 else f'l{n - 1}'})")
        items = "items"
    starts = f"range(0, greatest(1, 1 + ceil((length(x.text) - {SIZE}) / {SIZE - OVERLAP}.0)::INT))"
    whole = f"list_transform({starts}, lambda i: {{'kind': 3, 'text': substring(x.text, (i * {SIZE - OVERLAP} + 1)::INT, {SIZE})}})"
    end = "[{'kind': 2, 'text': ''}]"
    strip = f"regexp_replace(c, '^{BLANK}+|{BLANK}+$', '', 'g')"
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), long AS (SELECT * FROM docs WHERE length(t) > {SIZE}),
    {', '.join(steps)},
    cut AS (SELECT doc_id, flatten(list_transform(items, lambda x: CASE WHEN x.kind = 1 THEN {end} || {whole} || {end} ELSE [x] END)) AS items FROM l{len(SEPARATORS) - 1}),
    flat AS (SELECT doc_id, unnest(items) AS x, unnest(range(len(items))) AS i FROM cut),
    runs AS (SELECT doc_id, i, x.kind AS kind, x.text AS text, sum(CASE WHEN x.kind >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM flat),
    placed AS (SELECT doc_id, g, i, text, sum(length(text)) OVER (PARTITION BY doc_id, g ORDER BY i) AS upto FROM runs WHERE kind <> 2),
    spans AS (SELECT doc_id, g, string_agg(text, '' ORDER BY i) AS text, list(upto::INT ORDER BY i) AS ends, list((upto - length(text))::INT ORDER BY i) AS starts FROM placed GROUP BY 1, 2),
    walk AS (
      SELECT doc_id, g, 0 AS b, list_max(list_filter(ends, lambda x: x <= {SIZE})) AS e FROM spans
      UNION ALL
      SELECT doc_id, g, b, list_max(list_filter(ends, lambda x: x <= b + {SIZE})) AS e
      FROM (SELECT w.doc_id, w.g, s.ends, coalesce(list_min(list_filter(s.starts, lambda x: x < w.e AND x >= w.e - least({OVERLAP}, {SIZE} - (list_min(list_filter(s.ends, lambda y: y > w.e)) - w.e)))), w.e) AS b
            FROM walk w JOIN spans s ON s.doc_id = w.doc_id AND s.g = w.g WHERE w.e < list_max(s.ends))),
    made AS (SELECT w.doc_id, w.g, w.b, substring(s.text, w.b + 1, w.e - w.b) AS c FROM walk w JOIN spans s ON s.doc_id = w.doc_id AND s.g = w.g
             UNION ALL SELECT doc_id, 0, 0, t FROM docs WHERE length(t) <= {SIZE}),
    good AS (SELECT doc_id, g, b, {strip} AS c FROM made),
    kept AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g, b) - 1)::INT AS n, c AS chunk FROM good WHERE c <> '')
    SELECT doc_id, n, chunk FROM kept UNION ALL SELECT doc_id, 0, t FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM kept)"""


HOSTS = f"hosts AS (SELECT page_id, {NETLOC.format('url')} AS host, html FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)"

ORACLE_SQL = {
    "benchmark_hits": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND contains(lower(d.text), lower(b.text))",
    "chunks_recursive": _chunks(),
    "ivf_recall": """SELECT count(*) AS queries, (count(*) * least(10, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL)))::BIGINT AS neighbours, true AS reached
        FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL""",
    "stream_signature_clusters": f"""WITH RECURSIVE {SIGNED}, banded AS (SELECT id, unnest(range(32)) AS b, m FROM signed), keyed AS (SELECT id, b, m[b * 4 + 1:b * 4 + 4] AS k, m FROM banded),
        near AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keyed x JOIN keyed y ON x.b = y.b AND x.k = y.k AND x.id < y.id AND y.id - x.id <= 14 * 24
                 WHERE len(list_filter(range(1, 129), lambda i: x.m[i] = y.m[i])) >= 128 * 0.8),
        {reach('near')} SELECT t.id, coalesce(root, t.id) AS root FROM texts t LEFT JOIN roots ON node = t.id""",
    "stream_source_streaks": f"{HEALTH} SELECT source_id, status, last_status, last_ok_at, consecutive_failures, last_error FROM health",
    "blob_put": "SELECT DISTINCT sha256(text) AS content_hash, sha256(text)[1:2] || '/' || sha256(text) AS blob_uri, octet_length(encode(text))::INT AS n_bytes FROM documents WHERE text IS NOT NULL",
    "site_pages": f"WITH {HOSTS} SELECT 'https://' || host || '/' AS endpoint, 'https://' || host || '/open/' || page_id AS url, md5(html) AS html_md5 FROM hosts WHERE host <> '' AND page_id % 10 <> 7",
    "conditional_outcomes": f"""WITH {HOSTS} SELECT host AS source_id, CASE WHEN bool_or(page_id % 5 = 0) THEN 'error' WHEN count(*) = 1 THEN 'not_modified' ELSE 'ok' END AS status,
        (count(*) = 1)::BIGINT AS conditional, CASE WHEN count(*) = 1 THEN 0 ELSE count(*) FILTER (page_id % 5 <> 0) END::BIGINT AS renewed FROM hosts WHERE host <> '' GROUP BY host""",
    "brief_bodies": rf"""WITH RECURSIVE {EVENTS},
        lines AS (SELECT claim_group, coalesce(story_cluster, '') AS story, sids, unnest(sources) AS body_id, regexp_replace({ws('text')}, '\.+$', '') || ' ('
            || CASE verdict WHEN 'confirmed' THEN 'confirmed by ' || independent_voices || ' independent source' || CASE WHEN independent_voices <> 1 THEN 's' ELSE '' END
               WHEN 'attributed' THEN 'reported by ' || array_to_string(sources, ', ') || ', unconfirmed'
               WHEN 'contradicted' THEN 'CONFLICTING REPORTS — ' || coalesce(conflict, 'sources disagree') ELSE 'unverified' END
            || '). ' || array_to_string(list_transform(sids, lambda x: '[' || x || ']'), '') AS out FROM events_out WHERE NOT dropped),
        cited AS (SELECT body_id, story, claim_group, unnest(sids) AS sid, unnest(range(len(sids))) AS i FROM lines),
        heads AS (SELECT body_id, story, arg_min(substring(string_split(claim, chr(10))[1], 1, 90), struct_pack(g := claim_group, i := i)) AS head FROM cited JOIN claims USING (sid) GROUP BY 1, 2),
        parts AS (SELECT body_id, story, min(claim_group) AS first, string_agg(out, chr(10) ORDER BY claim_group) AS body FROM lines GROUP BY 1, 2)
        SELECT p.body_id, string_agg('### ' || coalesce(head, nullif(p.story, ''), 'Untitled') || chr(10) || body, chr(10) || chr(10) ORDER BY first) AS body
        FROM parts p LEFT JOIN heads h ON h.body_id = p.body_id AND h.story = p.story GROUP BY p.body_id""",
    "sparse_topk_pruned": f"WITH {sparse(10)} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM sparse",
    "corroborate_fallbacks": f"""WITH RECURSIVE {EVENTS}, r AS (SELECT claim_group, CASE WHEN verdict = 'attributed' THEN 'insufficient' ELSE verdict END AS verdict FROM events_out)
        SELECT fallback, claim_group, verdict, fallback = 'drop' AND verdict = 'insufficient' AS dropped FROM r, (VALUES ('flag'), ('drop')) f(fallback)""",
    "quants_relative": f"WITH RECURSIVE {QUANTS.replace('> 0.015', '> 0.3::DOUBLE * greatest(abs(a.anchor), abs(q.value))')} SELECT * FROM quants_out",
    "governance_decisions": f"""WITH l AS (SELECT *, {NETLOC.format('url')} AS netloc FROM pages), c AS (SELECT DISTINCT netloc FROM l WHERE netloc <> ''
          AND netloc NOT IN (SELECT netloc FROM l WHERE url LIKE 'https://m.%') AND netloc NOT IN (SELECT netloc FROM l WHERE url LIKE '%//blog.%')),
        s AS (SELECT netloc, CASE WHEN length(netloc) % 3 = 0 THEN 'rejected' WHEN length(netloc) % 2 = 0 THEN 'approved' ELSE 'pending' END AS status FROM c)
        SELECT netloc, status, CASE WHEN status = 'rejected' THEN 'off topic' END AS reason,
        CASE WHEN status = 'approved' THEN '- id: ' || translate(netloc, '.-', '__') || chr(10) || '  name: ' || netloc || chr(10) || '  homepage: https://' || netloc
          || chr(10) || '  status: paused' || chr(10) || '  license: UNREVIEWED' END AS yaml FROM s""",
    "feed_scan": """WITH d AS (SELECT 'feed://' || source AS endpoint, doc_id, coalesce(md5(text), doc_id::VARCHAR) AS content,
          CASE WHEN doc_id % 3 > 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id END AS published_at FROM documents WHERE source IS NOT NULL)
        SELECT * FROM d WHERE published_at IS NULL OR published_at > TIMESTAMP '2024-01-08'""",
    "clusters_by_batches": f"""WITH RECURSIVE {PAIRS}, before AS (SELECT b, min(a) AS a FROM pairs GROUP BY b),
        way AS (SELECT id, id AS reached FROM texts UNION ALL SELECT w.id, p.a FROM way w JOIN before p ON p.b = w.reached)
        SELECT id, min(reached) AS cluster FROM way GROUP BY id""",
}
