"""``store_queries.py`` as DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

from .oracles import CANDIDATES, ITEMS, NOW, ORACLE_SQL, RAW

_PATH = "'/' || CASE WHEN type IN ('PATCH','UPDATE') THEN 'patches' WHEN type IN ('EVENT','BANNER') THEN 'events' WHEN type IN ('REWARD','REDEEM_CODE') THEN 'rewards' ELSE 'notices' END || '/' || game_id || '-' || id"
_DAY = "['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow({0})]"
_SEOUL = "({0} + INTERVAL 9 HOUR)"
_SHOWN = "strftime({0}, '%m.%d') || ' (' || " + _DAY + " || ')' || CASE WHEN number % 3 = 0 THEN '' ELSE strftime({0}, ' %H:%M') END"
_TEXT = lambda c: _SHOWN.format(_SEOUL.format(c))

_SQL = {
    "pulse_items": f"""WITH {ITEMS}, x AS (SELECT *, (number % 6)::INTEGER AS c, (number % 7)::INTEGER AS n FROM pub)
SELECT id, {_PATH} AS href, CASE WHEN number % 4 = 0 THEN 'DATE' ELSE 'DATETIME' END AS precision, 'source ' || authority AS source_name, CASE WHEN type = 'PATCH' THEN '1.' || id END AS version, CASE WHEN type = 'PATCH' THEN c END AS change_count,
  CASE WHEN type = 'PATCH' THEN array_to_string(['thing 1 1 → 2', 'thing 2 power 2 → 3', 'thing 3'][1:c], '; ') END AS changes, CASE WHEN type IN ('EVENT','REWARD','MAINTENANCE','BANNER') THEN 'KIND' END AS label,
  CASE WHEN type = 'REDEEM_CODE' THEN 'C' || id END AS code,
  CASE WHEN type IN ('EVENT','REWARD','REDEEM_CODE') THEN array_to_string(['item 1','item 2','item 3','item 4'][1:n], '; ') WHEN type = 'BANNER' THEN array_to_string(['item 1','item 2','item 3','item 4','item 5','item 6'][1:n], '; ') END AS items FROM x""",
    "slug_list": f"WITH {ITEMS} SELECT id, game_id || '-' || id AS slug, type, game_id, updated_at FROM pub ORDER BY updated_at DESC, slug LIMIT 500",
    "content_page": f"""WITH {ITEMS} SELECT id, game_id || '-' || id AS slug, CASE WHEN number % 3 = 0 THEN 'about ' || title ELSE title END AS description,
  '{{"@context":"https://schema.org","@type":"Event","name":"\\u003c' || title || '","url":"https://x.example/"}}' AS json_ld, NOT is_synthetic AND NOT (type = 'ANNOUNCEMENT' AND number % 3 <> 0) AS indexable
FROM pub WHERE game_id || '-' || id IN ('lol-15', 'lostark-1')""",
    "game_tabs": f"""WITH {ITEMS} SELECT game_id, CASE WHEN type IN ('PATCH','UPDATE') THEN 'patches' WHEN type IN ('EVENT','BANNER') THEN 'events' ELSE 'rewards' END AS tab, count(*) AS items FROM pub
WHERE game_id IN ('lol','lostark','genshin') AND type NOT IN ('MAINTENANCE','ANNOUNCEMENT') AND CASE WHEN type IN ('PATCH','UPDATE') OR (start_at IS NULL AND end_at IS NULL) THEN eff BETWEEN {NOW} - INTERVAL 120 DAY AND {NOW} + INTERVAL 120 DAY
  ELSE coalesce(end_at >= {NOW} - INTERVAL 120 DAY, true) AND coalesce(start_at <= {NOW} + INTERVAL 120 DAY, true) END GROUP BY ALL""",
    "game_features": """WITH f AS (SELECT n_name, f, (n_nationkey + i * (n_nationkey % 2 + 1)) % 3 AS level FROM nation, (VALUES ('patches', 0), ('events', 1), ('banners', 2), ('rewards', 3), ('redeemCodes', 4), ('resets', 5)) t(f, i) WHERE n_nationkey % 5 <> 0),
g AS (SELECT n_name, coalesce(string_agg(f, ',' ORDER BY f) FILTER (level < 2), '') AS features, coalesce(string_agg(f, ',' ORDER BY f) FILTER (level = 1), '') AS limited, list(f) FILTER (level < 2) AS has FROM f GROUP BY 1)
SELECT n_name AS game_id, 'overview,calendar' || CASE WHEN list_contains(has, 'patches') THEN ',patches' ELSE '' END || CASE WHEN list_has_any(has, ['events','banners']) THEN ',events' ELSE '' END || CASE WHEN list_has_any(has, ['rewards','redeemCodes']) THEN ',rewards' ELSE '' END
  || CASE WHEN list_contains(has, 'resets') THEN ',resets' ELSE '' END AS tabs, features, limited FROM g""",
    "hidden_items": f"WITH {ITEMS} SELECT count(*) AS hidden FROM pub WHERE number IN (SELECT number * 3 FROM items)",
    "raw_upserts": f"""WITH {RAW}, st AS (SELECT source_id, document_key, content_hash, min(fetched_at) AS f FROM raw GROUP BY ALL HAVING min(fetched_at) < TIMESTAMP '2024-01-20'),
nw AS (SELECT source_id, document_key, content_hash, max(fetched_at) AS m FROM raw WHERE fetched_at >= TIMESTAMP '2024-01-10' GROUP BY ALL),
b AS (SELECT source_id, document_key, content_hash, f, m, greatest(f, m) AS c FROM st FULL JOIN nw USING (source_id, document_key, content_hash)),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id, document_key ORDER BY c DESC, content_hash DESC) AS n FROM b)
SELECT source_id, CASE WHEN f IS NULL THEN 'inserted' WHEN m IS NULL THEN 'kept' ELSE 'checked' END AS action, count(*) AS documents, count(DISTINCT document_key) AS keys,
  count(*) FILTER (n = 1 AND (source_id, document_key) IN (SELECT (source_id, document_key) FROM nw)) AS touched FROM r GROUP BY ALL""",
    "maintenance_sweep": f"""WITH {ITEMS}, x AS (SELECT number, id, authority, published_at AS p, CASE authority WHEN 1 THEN 3 WHEN 3 THEN 7 END AS ttl FROM items),
g AS (SELECT *, coalesce(p < {NOW} - to_days(ttl), false) AS gone, coalesce(p - INTERVAL 2 DAY < {NOW} - to_days(ttl), false) AS old FROM x)
SELECT s AS source_id, count(*) FILTER (gone) AS content, count(*) FILTER (old) AS raw_documents, count(*) FILTER (old AND number % 2 = 0) AS parse_results FROM (VALUES ('src-1', 1), ('src-3', 3), ('src-9', 9)) t(s, a) LEFT JOIN g ON authority = a GROUP BY 1
UNION ALL SELECT 'content left', count(*), 0, 0 FROM g WHERE NOT gone UNION ALL SELECT 'children left', coalesce(sum(length(id) % 3 + 1), 0)::BIGINT, 0, 0 FROM g WHERE NOT gone
UNION ALL SELECT 'raw left', count(*), 0, 0 FROM g WHERE NOT old UNION ALL SELECT 'parses left', count(*), 0, 0 FROM g WHERE NOT old AND number % 2 = 0""",
    "provenance_names": f"""WITH {CANDIDATES}, rolled AS (SELECT game_id || ':' || kind || ':' || title AS content_id, source_id, source_key, min(start_at) AS f, min(authority) AS a FROM cand GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY a, f, source_id, source_key) = 1 AS is_first FROM rolled)
SELECT content_id, 'source ' || substr(source_id, 5) AS name, CASE WHEN is_first THEN 'PRIMARY' ELSE 'SUPPORTING' END AS role, row_number() OVER (PARTITION BY content_id ORDER BY NOT is_first, f, source_id, source_key)::INTEGER AS place FROM r QUALIFY place <= 3""",
    "recent_runs": """SELECT event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 'RUNNING' WHEN event_id % 2 = 0 THEN 'SUCCEEDED' ELSE 'PARTIAL' END AS status, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 5 MINUTE END AS finished_at
FROM events ORDER BY ts DESC, event_id LIMIT 50""",
    "replaced_details": """WITH a AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'F')
SELECT k AS content_id, count(*) AS changes, sum(p)::BIGINT AS parts FROM a GROUP BY 1""",
    "version_pairs": "SELECT '14.' || p_partkey AS version, '14.' || lead(p_partkey) OVER (ORDER BY p_partkey DESC) AS previous FROM part",
    "period_texts": f"""WITH {ITEMS}, x AS (SELECT *, coalesce(end_at, published_at) AS t, greatest(floor((epoch_us(coalesce(end_at, published_at)) - epoch_us({NOW})) / 1000000), 0)::BIGINT AS s, number % 3 = 0 AS day_only,
    date_diff('day', DATE '2024-01-16', (coalesce(end_at, published_at) + INTERVAL 9 HOUR)::DATE) AS dd, CASE WHEN number % 2 = 0 THEN date_trunc('day', published_at) ELSE date_trunc('minute', published_at) END - INTERVAL 9 HOUR AS l FROM items),
y AS (SELECT *, CASE WHEN dd = 0 THEN 'D-DAY' WHEN dd > 0 THEN 'D-' || dd ELSE 'D+' || (-dd) END AS d, CASE WHEN s // 3600 < 100 THEN lpad((s // 3600)::VARCHAR, 2, '0') ELSE (s // 3600)::VARCHAR END || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS c FROM x)
SELECT id, CASE WHEN start_at IS NOT NULL AND end_at IS NOT NULL THEN {_TEXT("start_at")} || ' – ' || {_TEXT("end_at")} WHEN start_at IS NOT NULL THEN {_TEXT("start_at")} || ' ~' WHEN end_at IS NOT NULL THEN '~ ' || {_TEXT("end_at")} END AS period,
  strftime({_SEOUL.format("published_at")}, '%Y.%m.%d') || ' (' || {_DAY.format(_SEOUL.format("published_at"))} || ')' AS heading,
  CASE WHEN t <= {NOW} THEN '종료' WHEN day_only OR s >= 86400 THEN d ELSE c END AS auto, CASE WHEN t <= {NOW} THEN '종료' WHEN day_only THEN d ELSE c END AS clock, CASE WHEN t <= {NOW} THEN '종료' ELSE d END AS days,
  l AS from_at, CASE WHEN number % 2 = 0 THEN l + INTERVAL 1439 MINUTE ELSE l END AS until_at, (published_at::DATE + INTERVAL 1 MONTH)::DATE AS next_month FROM y""",
    "snapshot_feed": """SELECT 'CHAMPION' AS target_type, p_partkey::VARCHAR AS target_key, 'BUFF' AS change, 'Q bolt cost' AS field FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT 'ITEM', p_partkey::VARCHAR, 'NERF', 'gold' FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 = 0""",
}

ORACLE_SQL.update(_SQL)
