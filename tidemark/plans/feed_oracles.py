"""``feed_queries.py`` as DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

from .oracles import ALL_RULES, CHECKED, ITEMS, NOW, ORACLE_SQL, RULES, TWO_BATCHES

_LINK = """CASE WHEN event_id % 5 = 0 THEN 'https://other.example.net' WHEN event_id % 2 = 0 THEN 'https://game.example.com' ELSE 'https://www.news.example.org' END || '/views/' || event_id"""
_NONE = "NULL::VARCHAR"
_STAMP = "NULL::TIMESTAMP"
_MIN = "date_trunc('minute', ts)"

_EVENTS = f"""
ev AS (
  SELECT event_id, event_id::VARCHAR AS n, event_type || ' ' || (user_id % 40) AS title, {_LINK} AS link,
    {_MIN} - INTERVAL 9 HOUR AS s, CASE WHEN event_id % 7 <> 0 THEN {_MIN} - INTERVAL 9 HOUR + INTERVAL 2 DAY END AS e,
    CASE WHEN event_id % 3 = 0 THEN {_MIN} - INTERVAL 9 HOUR + INTERVAL 5 DAY END AS claim
  FROM events WHERE event_id % 31 <> 0 AND event_id % 5 <> 0
)"""

_FEEDS = {
    "feed_events": f"""
WITH {_EVENTS}
SELECT 'EVENT' AS kind, 'event:' || n AS source_key, 'event-' || n AS slug_hint, title, s AS start_at, e AS end_at, link AS source_url, {_STAMP} AS source_published_at, 50::INTEGER AS priority, {_NONE} AS maintenance_type, {_NONE} AS related_source_key FROM ev
UNION ALL
SELECT 'REWARD', 'event:' || n || '#reward', 'event-' || n || '-reward', title || ' 보상 수령', s, claim, link, {_STAMP}, 55, {_NONE}, 'event:' || n FROM ev WHERE claim IS NOT NULL""",
    "feed_notices": f"""
SELECT CASE event_id % 3 WHEN 0 THEN 'MAINTENANCE' ELSE 'ANNOUNCEMENT' END AS kind, 'notice:' || event_id AS source_key, 'notice-' || event_id AS slug_hint,
  CASE event_id % 4 WHEN 0 THEN '긴급 ' WHEN 1 THEN '연장 ' ELSE '' END || '점검 ' || event_id AS title, {_STAMP} AS start_at, {_STAMP} AS end_at, {_LINK} AS source_url,
  {_MIN} - INTERVAL 9 HOUR AS source_published_at, CASE event_id % 3 WHEN 0 THEN 75 ELSE 40 END::INTEGER AS priority,
  CASE WHEN event_id % 3 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'EMERGENCY' WHEN 1 THEN 'EXTENDED' ELSE 'SCHEDULED' END END AS maintenance_type, {_NONE} AS related_source_key
FROM events WHERE event_id % 3 <> 2 AND event_id % 5 <> 0""",
    "feed_keyed_notices": f"""
WITH k AS (
  SELECT *, CASE event_id % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'update' ELSE 'notice' END AS key, {_MIN} - INTERVAL 9 HOUR AS s, event_id % 2 = 0 AS work FROM events WHERE event_id % 5 <> 0
)
SELECT CASE WHEN key = 'event' THEN 'EVENT' WHEN key = 'update' THEN 'UPDATE' WHEN work THEN 'MAINTENANCE' ELSE 'ANNOUNCEMENT' END AS kind, key || ':' || event_id AS source_key, key || '-' || event_id AS slug_hint,
  CASE WHEN work THEN '정기점검 ' ELSE '안내 ' END || event_type AS title, CASE WHEN key = 'event' THEN s END AS start_at, CASE WHEN key = 'event' THEN s + INTERVAL 3 DAY END AS end_at, {_LINK} AS source_url,
  s AS source_published_at, CASE WHEN key = 'event' THEN 50 WHEN key = 'update' THEN 65 WHEN work THEN 75 ELSE 40 END::INTEGER AS priority,
  CASE WHEN key = 'notice' AND work THEN 'SCHEDULED' END AS maintenance_type, {_NONE} AS related_source_key
FROM k""",
    "feed_status": f"""
WITH t AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN '점검 안내' ELSE event_type END AS title, {_MIN} AS p FROM events WHERE event_id % 5 <> 0)
SELECT 'MAINTENANCE' AS kind, 'maintenance:' || event_id * 2 AS source_key, 'status-maintenance-' || event_id * 2 AS slug_hint, title, {_STAMP} AS start_at, {_STAMP} AS end_at, 'https://status.example.com' AS source_url,
  p AS source_published_at, 75::INTEGER AS priority, 'SCHEDULED' AS maintenance_type, {_NONE} AS related_source_key, 'new ' || event_type AS summary FROM t
UNION ALL
SELECT 'ANNOUNCEMENT', 'incident:' || (event_id * 2 + 1), 'status-incident-' || (event_id * 2 + 1), title, {_STAMP}, {_STAMP}, 'https://status.example.com', p, CASE WHEN event_id % 3 = 2 THEN 85 ELSE 60 END, {_NONE}, {_NONE}, 'new ' || event_type
FROM t WHERE event_id % 3 <> 0""",
    "feed_rejections": """
SELECT feed, reason, count(*) AS items FROM (
  SELECT 'events' AS feed, CASE WHEN event_id % 31 = 0 THEN 'unexpected shape' WHEN event_id % 5 = 0 THEN 'link outside allowed hosts' END AS reason FROM events
  UNION ALL SELECT 'notices', CASE WHEN event_id % 5 = 0 AND event_id % 3 <> 2 THEN 'link outside allowed hosts' END FROM events
  UNION ALL SELECT 'keyed', CASE WHEN event_id % 5 = 0 THEN 'link outside allowed hosts' END FROM events
  UNION ALL SELECT 'status', CASE WHEN event_id % 5 = 0 THEN 'no title in a known language' END FROM events
  UNION ALL SELECT 'status', CASE WHEN event_id % 5 = 0 AND event_id % 3 <> 0 THEN 'no title in a known language' END FROM events
) WHERE reason IS NOT NULL GROUP BY ALL""",
    "date_ranges": f"""
WITH n AS (
  SELECT *, event_id % 6 AS form, event_id % 4 AS l, {_MIN} AS s, CASE WHEN event_id % 6 = 1 THEN date_trunc('day', ts) + INTERVAL 1439 MINUTE ELSE {_MIN} + INTERVAL 3 DAY END AS e,
    CASE WHEN event_id % 6 = 1 THEN 9 WHEN event_id % 4 = 1 THEN 9 WHEN event_id % 4 = 3 THEN NULL ELSE 8 END AS off
  FROM events WHERE event_id % 6 <> 0 AND event_id % 5 <> 3
)
SELECT event_id AS number, ['EVENT','MAINTENANCE','REWARD','PATCH','EVENT'][event_id % 5 + 1] AS kind, s - to_hours(off) AS start_at, e - to_hours(off) AS end_at,
  CASE off WHEN 9 THEN 'Asia/Seoul' WHEN 8 THEN 'UTC+8' END AS zone,
  strftime(s, '%Y/%m/%d %H:%M') || CASE WHEN form = 1 THEN '' ELSE [' (UTC+8)',' (한국 시간)',' (서버 시간)',' (somewhere)'][l + 1] END AS start_at_source,
  CASE WHEN off IS NULL THEN 0.3 ELSE 0.9 END::DOUBLE AS confidence
FROM n""",
    "extraction_mapping": """
WITH d AS (SELECT *, event_id % 7 = 0 AS two, CASE event_id % 3 WHEN 0 THEN 'PATCH' WHEN 1 THEN 'REDEEM_CODE' ELSE 'MAINTENANCE' END AS k FROM events)
SELECT k AS kind, event_id || CASE WHEN two THEN '#0' ELSE '' END AS source_key, event_type AS title, ts AS start_at, CASE WHEN event_id % 2 = 0 THEN 'DATETIME' END AS precision, CASE WHEN event_id % 2 = 0 THEN 'kr' END AS region,
  CASE WHEN k = 'REDEEM_CODE' THEN 'C' || event_id END AS code, CASE WHEN k = 'PATCH' THEN event_id::VARCHAR END AS version, CASE WHEN k = 'MAINTENANCE' THEN 'SCHEDULED' END AS maintenance_type
FROM d WHERE NOT (k = 'PATCH' AND event_id % 4 = 0) AND NOT (k = 'REDEEM_CODE' AND event_id % 5 = 0)
UNION ALL
SELECT 'EVENT', event_id || '#1', event_type, ts, CASE WHEN event_id % 2 = 0 THEN 'DATETIME' END, CASE WHEN event_id % 2 = 0 THEN 'kr' END, NULL, NULL, NULL FROM d WHERE two""",
    "champion_diff": r"""
WITH b AS (SELECT *, p_size::DOUBLE AS size FROM part WHERE p_partkey % 10 > 1), n AS (
  SELECT p_partkey, 'NEW' AS change, NULL::VARCHAR AS field, NULL::DOUBLE AS a, NULL::DOUBLE AS c, NULL::VARCHAR AS unit, NULL::VARCHAR AS bt, NULL::VARCHAR AS aft FROM part WHERE p_partkey % 10 = 0
  UNION ALL SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'BUFF' ELSE 'NERF' END, 'armor', p_retailprice, round(p_retailprice + CASE p_partkey % 3 WHEN 0 THEN 1 ELSE -1 END, 2), NULL, NULL, NULL FROM b WHERE p_partkey % 3 <> 2
  UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 8 = 0 THEN 'ADJUST' WHEN p_partkey % 4 = 0 THEN 'BUFF' ELSE 'NERF' END, 'Q bolt cooldown', NULL, NULL, '초',
    (p_size + 1) || '/' || p_size, CASE WHEN p_partkey % 8 = 0 THEN p_size || '/' || (p_size + 2) WHEN p_partkey % 4 = 0 THEN p_size::VARCHAR END FROM b WHERE p_partkey % 4 = 0
)
SELECT p_partkey::VARCHAR AS target_key, change, field, coalesce(bt, regexp_replace(printf('%.4f', a), '\.?0+$', '')) AS before, coalesce(aft, regexp_replace(printf('%.4f', c), '\.?0+$', '')) AS after, unit FROM n""",
    "item_diff": """
WITH b AS (SELECT *, floor(p_retailprice)::BIGINT AS g FROM part WHERE p_partkey % 10 > 1)
SELECT p_partkey::VARCHAR AS target_key, CASE p_partkey % 10 WHEN 0 THEN 'NEW' ELSE 'REMOVED' END AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM part WHERE p_partkey % 10 < 2
UNION ALL SELECT p_partkey::VARCHAR, 'NERF', 'gold', g::VARCHAR, (g + 50)::VARCHAR FROM b WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey::VARCHAR, CASE WHEN p_partkey % 5 = 0 THEN 'BUFF' ELSE 'NERF' END, 'power', CASE WHEN p_partkey % 5 = 0 THEN '0' ELSE p_size::VARCHAR END, CASE WHEN p_partkey % 5 = 0 THEN p_size::VARCHAR ELSE '0' END
FROM b WHERE (p_partkey % 5 = 0) <> (p_partkey % 7 = 0) AND p_size <> 0""",
}

_FEEDS["diff_summary"] = f"""
SELECT 'CHAMPION' AS target_type, count(*) AS changes, count(DISTINCT target_key) AS touched FROM ({_FEEDS["champion_diff"]})
UNION ALL SELECT 'ITEM', count(*), count(DISTINCT target_key) FROM ({_FEEDS["item_diff"]})"""

_REST = {
    "parse_cache_misses": f"""
WITH n AS (
  SELECT event_id, ['EVENT','MAINTENANCE','REWARD','PATCH','CLASSIFY'][event_id % 5 + 1] AS task,
    CASE event_id % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'a' || {_MIN} WHEN 2 THEN 'b' || {_MIN} || event_id % 4 ELSE 'c' || {_MIN} || event_id % 4 END AS text FROM events
), known AS (SELECT DISTINCT task, text FROM n WHERE event_id % 2 = 0 AND event_id % 10 <> 0)
SELECT task, count(*) AS texts FROM n ANTI JOIN known USING (task, text) GROUP BY ALL""",
    "related_links": f"""
WITH {ITEMS}
SELECT i.id, t.id AS related_id FROM items i JOIN items t ON t.source_key = (i.number - 6)::VARCHAR AND t.authority = i.authority WHERE i.type = 'REWARD' AND t.status = 'PUBLISHED'""",
    "patch_children": """
WITH l AS (SELECT l_orderkey, list({'p': l_linenumber, 'k': l_partkey, 's': l_suppkey} ORDER BY l_linenumber, l_partkey, l_suppkey) AS x FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderstatus, coalesce(len(x), 0)::INTEGER AS n_changes, x[1].k AS first_part, x[-1].k AS last_part FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "entity_resolution": """
WITH k AS (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0), n AS (SELECT l_partkey, l_partkey IN (SELECT p_partkey FROM k) AS known FROM lineitem)
SELECT CASE WHEN known THEN 'known' ELSE 'new' END AS state, count(*) AS rows, count(DISTINCT l_partkey) AS entities FROM n GROUP BY 1
UNION ALL SELECT 'added', count(DISTINCT l_partkey), count(DISTINCT l_partkey) FROM n WHERE NOT known""",
    "viewer_preferences": """
SELECT c_custkey AS viewer, ['lol,lostark,maplestory,genshin,wuwa','lol','lol,wuwa','lol,wuwa','lol,wuwa','lol,wuwa,genshin'][c_custkey % 6 + 1] AS games, least(c_custkey % 700 + 1, 500)::INTEGER AS n_dismissed,
  'd' || greatest(c_custkey % 700 + 1 - 499, 1) AS first_dismissed, ['Asia/Tokyo','Asia/Seoul','UTC+8'][c_custkey % 3 + 1] AS timezone, CASE WHEN c_custkey % 2 = 0 THEN 'en-US' ELSE 'ko-KR' END AS locale
FROM customer""",
    "viewer_feed": f"WITH {ITEMS} SELECT id, game_id FROM pub WHERE game_id IN ('lol', 'wuwa') AND number % 4 <> 0",
    "schedule_plan": """
SELECT * FROM (VALUES
  ('a-live', 'live', NULL, NULL, 15), ('b-paused', 'live', 'NOT_ENABLED', 'PAUSED', NULL), ('c-keyless', 'live', 'MISSING_CREDENTIALS', 'OTHER_KEY', NULL), ('d-manual', 'live', 'NO_SCHEDULE', NULL, NULL), ('e-fixture', 'live', 'UNSUPPORTED_MODE', 'live', NULL),
  ('a-live', 'mock', NULL, NULL, 15), ('b-paused', 'mock', 'UNSUPPORTED_MODE', 'mock', NULL), ('c-keyless', 'mock', NULL, NULL, 30), ('d-manual', 'mock', 'UNSUPPORTED_MODE', 'mock', NULL), ('e-fixture', 'mock', 'UNSUPPORTED_MODE', 'mock', NULL),
  ('a-live', 'fixture', 'UNSUPPORTED_MODE', 'fixture', NULL), ('b-paused', 'fixture', 'UNSUPPORTED_MODE', 'fixture', NULL), ('c-keyless', 'fixture', 'UNSUPPORTED_MODE', 'fixture', NULL), ('d-manual', 'fixture', 'UNSUPPORTED_MODE', 'fixture', NULL), ('e-fixture', 'fixture', NULL, NULL, 60)
) t(adapter_id, mode, reason, about, every_minutes)
UNION ALL SELECT 's' || k, mode, reason, CASE reason WHEN 'UNSUPPORTED_MODE' THEN mode WHEN 'NOT_ENABLED' THEN 'PAUSED' WHEN 'MISSING_CREDENTIALS' THEN 'OTHER_KEY' END, CASE WHEN reason IS NULL THEN CASE WHEN mode = 'fixture' THEN 60 ELSE every END END
FROM (SELECT k, mode, every, CASE WHEN NOT has THEN 'UNSUPPORTED_MODE' WHEN mode = 'live' AND k % 4 = 0 THEN 'NOT_ENABLED' WHEN mode = 'live' AND k % 7 = 0 THEN 'MISSING_CREDENTIALS' WHEN mode <> 'fixture' AND every IS NULL THEN 'NO_SCHEDULE' END AS reason
  FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 <> 0 THEN s_suppkey % 60 + 1 END AS every, mode, CASE mode WHEN 'live' THEN s_suppkey % 5 <> 0 WHEN 'mock' THEN s_suppkey % 2 = 0 ELSE s_suppkey % 3 = 0 END AS has
    FROM supplier, (VALUES ('live'), ('mock'), ('fixture')) m(mode)))""",
    "sitemap_rows": f"""
WITH {ITEMS}
SELECT 'https://example.com' || p AS url, NULL::TIMESTAMP AS last_modified, f AS frequency, r::DOUBLE AS priority FROM (VALUES ('/', 'hourly', 1.0), ('/today', 'hourly', 0.8), ('/terms', 'monthly', 0.2)) t(p, f, r)
UNION ALL
SELECT 'https://example.com/' || CASE WHEN type IN ('PATCH','UPDATE') THEN 'patches' WHEN type IN ('EVENT','BANNER') THEN 'events' WHEN type IN ('REWARD','REDEEM_CODE') THEN 'rewards' ELSE 'notices' END || '/' || game_id || '-' || id, updated_at, 'daily', 0.5
FROM pub WHERE NOT is_synthetic""",
    "adapter_health": "SELECT s_nationkey, CASE WHEN bool_and(s_acctbal > 0) THEN 'HEALTHY' WHEN bool_and(s_acctbal <= 0) THEN 'UNHEALTHY' ELSE 'DEGRADED' END AS health, count(*) AS checks FROM supplier GROUP BY 1",
    "http_rules": """
SELECT event_id AS number, event_id % 7 > 2 AS retry, event_id % 7 IN (1, 4, 6) AND event_id % 5 = 0 AS challenged,
  CASE event_id % 3 WHEN 0 THEN event_id % 90 * 1000 WHEN 1 THEN 60000 END::BIGINT AS wait_ms,
  CASE event_id % 4 WHEN 0 THEN 1705363200000 + event_id % 60 * 1000 WHEN 1 THEN 1705363260000 WHEN 2 THEN 1705363260000 END::BIGINT AS reset_ms,
  least(30000, 500 * 2 ** (event_id % 9))::BIGINT AS ceiling_ms
FROM events""",
    "request_rate": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) AS recent FROM events",
    "content_details": f"""
WITH {ITEMS}, i AS (SELECT *, number % 17 <> 0 AS kept, lower(type) || '-' || id AS slug FROM items),
lines AS (SELECT l_orderkey AS number, list({{'afterValue': l_linenumber::VARCHAR, 'beforeValue': l_suppkey::VARCHAR, 'changeType': 'ADJUST', 'description': l_linestatus, 'field': CASE WHEN l_linenumber % 2 = 0 THEN 'size' END, 'targetKey': l_partkey::VARCHAR,
    'targetName': 'part ' || l_partkey, 'targetType': l_returnflag, 'unit': NULL::VARCHAR}} ORDER BY l_linenumber, l_returnflag, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linestatus) AS changes,
  list({{'name': 'part ' || l_partkey, 'quantity': CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber::DOUBLE END, 'unit': l_linestatus}} ORDER BY l_linenumber, 'part ' || l_partkey, l_linestatus) AS items,
  list({{'entityKey': l_partkey::VARCHAR, 'name': 'part ' || l_partkey, 'rarity': l_linenumber}} ORDER BY l_linenumber, 'part ' || l_partkey) AS featured FROM lineitem GROUP BY 1),
slugs AS (SELECT source_type, source_key, slug FROM i),
d AS (SELECT i.*, l.changes, l.items, l.featured, r.slug AS related, c.slug AS compensation FROM i LEFT JOIN lines l USING (number)
  LEFT JOIN slugs r ON i.kept AND i.type = 'REWARD' AND i.number % 2 = 1 AND r.source_key = (i.number - 24)::VARCHAR AND r.source_type = i.source_type
  LEFT JOIN slugs c ON i.kept AND i.type = 'MAINTENANCE' AND c.source_key = (i.number + 6)::VARCHAR AND c.source_type = i.source_type)
SELECT id, type, CASE type
  WHEN 'PATCH' THEN json_object('changes', coalesce(changes, []), 'releaseAt', CASE WHEN kept THEN strftime(start_at, '%Y-%m-%dT%H:%M:%S.%gZ') END, 'type', type, 'version', CASE WHEN kept THEN '1.' || number ELSE '' END)
  WHEN 'EVENT' THEN json_object('eligibility', CASE WHEN kept AND number % 4 = 2 THEN 'all' END, 'eventType', CASE WHEN kept AND number % 3 = 0 THEN 'LOGIN' ELSE 'OTHER' END, 'rewardSummary', CASE WHEN kept THEN title END, 'rewards', coalesce(items, []), 'type', type)
  WHEN 'REWARD' THEN json_object('howToClaim', CASE WHEN kept AND number % 3 = 0 THEN 'mail' END, 'items', coalesce(items, []), 'relatedSlug', related, 'rewardType', CASE WHEN kept THEN 'LOGIN' ELSE 'OTHER' END, 'type', type)
  WHEN 'REDEEM_CODE' THEN json_object('code', CASE WHEN kept THEN 'CODE' || number ELSE '' END, 'items', coalesce(items, []), 'region', CASE WHEN kept AND number % 3 = 0 THEN 'KR' END, 'type', type)
  WHEN 'MAINTENANCE' THEN json_object('affectedServers', CASE WHEN kept AND number % 2 = 1 THEN [game_id, 'all'] ELSE [] END, 'compensationSlug', compensation, 'maintenanceType', CASE WHEN kept AND number % 3 <> 0 THEN 'EMERGENCY' ELSE 'SCHEDULED' END, 'type', type)
  WHEN 'BANNER' THEN json_object('bannerType', CASE WHEN kept AND number % 3 = 0 THEN 'WEAPON' ELSE 'OTHER' END, 'featured', coalesce(featured, []), 'phase', CASE WHEN kept THEN priority::VARCHAR END, 'type', type)
  ELSE json_object('type', type) END::VARCHAR AS detail FROM d""",
    "manual_files": """
WITH o AS (SELECT *, o_orderkey AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT 'lol' AS game_id, CASE WHEN k % 3 = 0 THEN 'key-' || k ELSE 'manual' END AS source_key, 'order ' || k AS title, date_trunc('day', o_orderdate)::TIMESTAMP AS start_at, CASE WHEN k % 2 = 0 THEN k % 100 ELSE 50 END::INTEGER AS priority, k % 5 = 0 AS is_synthetic
FROM o WHERE k % 11 <> 0 AND k % 13 <> 0 AND o_custkey % 17 <> 0 AND n <= 200""",
    "adapter_files": """
WITH f AS (SELECT (o_orderkey // 150)::BIGINT AS file, count(*) AS n FROM orders GROUP BY 1)
SELECT file, CASE WHEN file % 17 <> 0 AND n <= 200 THEN n ELSE 0 END AS items, CASE WHEN file % 17 = 0 THEN 'another game' WHEN n > 200 THEN 'too many items' END AS reason FROM f""",
    "user_sessions": """
WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true) AS fresh FROM events),
s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS rows FROM s GROUP BY user_id, n""",
    "changed_documents": "SELECT source AS source_id, count(*) + count(*) FILTER (doc_id % 10 = 0) AS versions, count(*) AS documents FROM documents GROUP BY source",
    "item_words": f"""
WITH {ITEMS}, w AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') AS t, greatest(number % 4, number // 4 % 4) AS worse, number % 32 AS d FROM items)
SELECT id, CASE WHEN type = 'PATCH' AND number % 3 <> 0 THEN game_id || '-patch-v-1-' || number ELSE game_id || '-' || lower(replace(type, '_', '-')) || '-' || CASE WHEN number % 2 = 0 THEN t ELSE source_key END END AS slug,
  coalesce(end_at, eff) AS closed_at, CASE number % 3 WHEN 0 THEN '한국 시간' WHEN 1 THEN 'UTC+8' ELSE 'UTC-5' END AS zone, ['VALID','WARNING','REVIEW','INVALID'][worse + 1] AS worst,
  CASE WHEN d BETWEEN 1 AND 29 AND number % 7 <> 0 THEN make_date(2024, 2, d::INTEGER) END AS day FROM (SELECT w.*, coalesce(start_at, source_published_at, published_at) AS eff FROM w)""",
    "nested_issues": """
WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1 AS i,
    ['PATCH','UPDATE','EVENT','REWARD','REDEEM_CODE','MAINTENANCE','BANNER','ANNOUNCEMENT'][l_orderkey % 8 + 1] AS kind FROM lineitem),
c AS (SELECT DISTINCT k, kind FROM l),
lists AS (SELECT *, CASE kind WHEN 'EVENT' THEN 'event.rewards.' WHEN 'REWARD' THEN 'reward.items.' WHEN 'REDEEM_CODE' THEN 'redeemCode.items.' END || i AS item FROM l WHERE kind <> 'REWARD' OR k % 3 <> 0),
paths AS (
  SELECT k, 'patch' AS field FROM c WHERE kind = 'PATCH' AND k % 16 = 0
  UNION ALL SELECT k, 'patch.version' FROM c WHERE kind = 'PATCH' AND k % 16 <> 0 AND k % 5 = 0
  UNION ALL SELECT k, 'patch.changes.' || i || '.targetType' FROM l WHERE kind = 'PATCH' AND k % 16 <> 0 AND p % 2 <> 0
  UNION ALL SELECT k, 'patch.changes.' || i || '.targetName' FROM l WHERE kind = 'PATCH' AND k % 16 <> 0 AND p % 7 = 0
  UNION ALL SELECT k, 'patch.changes.' || i || '.afterValue' FROM l WHERE kind = 'PATCH' AND k % 16 <> 0 AND s % 9 = 0
  UNION ALL SELECT k, 'event.eventType' FROM c WHERE kind = 'EVENT' AND k % 3 <> 0
  UNION ALL SELECT k, 'event.eligibility' FROM c WHERE kind = 'EVENT' AND (k % 400 = 0 OR k % 400 > 300)
  UNION ALL SELECT k, 'reward.items' FROM c WHERE kind = 'REWARD' AND k % 3 = 0
  UNION ALL SELECT k, 'redeemCode.code' FROM c WHERE kind = 'REDEEM_CODE' AND k % 3 = 0
  UNION ALL SELECT k, item || '.name' FROM lists WHERE item IS NOT NULL AND p % 7 = 0
  UNION ALL SELECT k, item || '.quantity' FROM lists WHERE item IS NOT NULL AND p % 5 <> 0 AND n <= 2
  UNION ALL SELECT k, rtrim(item, '0123456789.') FROM (SELECT k, min(item) AS item, count(*) AS n FROM lists WHERE item IS NOT NULL GROUP BY k) WHERE n > 50
  UNION ALL SELECT k, 'maintenance.affectedServers.' || i FROM l WHERE kind = 'MAINTENANCE' AND p % 7 = 0
  UNION ALL SELECT k, 'banner.phase' FROM c WHERE kind = 'BANNER' AND k % 13 NOT BETWEEN 1 AND 10
  UNION ALL SELECT k, 'banner.featured.' || i || '.rarity' FROM l WHERE kind = 'BANNER' AND n > 4
  UNION ALL SELECT k, 'banner.featured' FROM (SELECT k, count(*) AS n FROM l WHERE kind = 'BANNER' GROUP BY k) WHERE n > 20
)
SELECT k AS candidate, 'SCHEMA' AS code, 'INVALID' AS severity, field FROM paths""",
    "localized_names": """
WITH n AS (SELECT l_partkey, arg_max('part ' || l_partkey || ' ' || l_orderkey, l_orderkey) AS value FROM lineitem WHERE l_partkey % 4 = 0 GROUP BY 1), s AS (SELECT * FROM part WHERE p_partkey % 3 <> 0)
SELECT coalesce(p_partkey, l_partkey)::VARCHAR AS entity_id, coalesce(value, p_name) AS value, CASE WHEN value IS NULL THEN 'HUMAN' ELSE 'SOURCE' END AS origin FROM s FULL JOIN n ON p_partkey = l_partkey""",
    "window_matches": f"""
WITH {ITEMS}, w AS (SELECT s_suppkey AS window_id, TIMESTAMP '2024-01-01 00:30:00' + to_hours(s_suppkey * 7919 % 720) AS a, TIMESTAMP '2024-01-01 00:30:00' + to_hours(s_suppkey * 7919 % 720 + s_suppkey % 48) AS b FROM supplier)
SELECT window_id, count(*) AS items, min(number) AS first_item FROM w JOIN pub ON
  CASE WHEN type IN ('PATCH', 'UPDATE', 'ANNOUNCEMENT') OR (start_at IS NULL AND end_at IS NULL) THEN coalesce(eff BETWEEN a AND b, false) ELSE coalesce(start_at <= b, true) AND coalesce(end_at >= a, true) AND coalesce(start_at <= end_at, true) END
GROUP BY window_id""",
    "run_admissions": """
WITH RECURSIVE r AS (
  SELECT (user_id % 20)::VARCHAR AS adapter_id, event_id::VARCHAR AS run_id, ts AS t, CASE WHEN event_id % 7 <> 0 THEN ts + to_minutes((floor(value * 7)::BIGINT % 600 + 1)) END AS f FROM events
), chain AS (
  SELECT adapter_id, unnest(arg_min({'run_id': run_id, 't': t, 'f': f, 'released': NULL::VARCHAR}, (t, run_id))) FROM r GROUP BY adapter_id
  UNION ALL
  SELECT adapter_id, unnest(arg_min({'run_id': n.run_id, 't': n.t, 'f': n.f, 'released': CASE WHEN n.t - c.t > INTERVAL 6 HOUR AND (c.f IS NULL OR c.f > n.t) THEN c.run_id END}, (n.t, n.run_id)))
  FROM chain c JOIN r n USING (adapter_id) WHERE (n.t, n.run_id) > (c.t, c.run_id) AND (c.f <= n.t OR n.t - c.t > INTERVAL 6 HOUR) GROUP BY adapter_id
)
SELECT r.adapter_id, r.run_id, c.run_id IS NOT NULL AS admitted, c.released FROM r LEFT JOIN chain c USING (adapter_id, run_id)""",
    "stale_runs": f"SELECT CASE WHEN event_id % 3 <> 0 THEN 'SUCCEEDED' WHEN {NOW} - ts > INTERVAL 30 MINUTE THEN 'ABANDONED' ELSE 'RUNNING' END AS status, count(*) AS runs FROM events GROUP BY 1",
    "item_badges": f"""
WITH {ITEMS}, b AS (
  SELECT *, coalesce(start_at, source_published_at) AS r FROM pub
), l AS (
  SELECT *, CASE WHEN type = 'MAINTENANCE' THEN kept
    WHEN type IN ('REWARD','REDEEM_CODE') THEN CASE st WHEN 'LIVE' THEN 'AVAILABLE' WHEN 'ENDED' THEN 'EXPIRED' WHEN 'ENDING_SOON' THEN 'CLAIM_SOON' ELSE st END
    WHEN type IN ('EVENT','BANNER') THEN nullif(st, 'UNKNOWN')
    WHEN type IN ('PATCH','UPDATE') THEN CASE WHEN r > {NOW} THEN 'RELEASING' WHEN {NOW} - r <= INTERVAL 3 DAY THEN 'NEW' WHEN r IS NOT NULL THEN 'RELEASED' END END AS label FROM b
)
SELECT id, CASE WHEN label IN ('UPCOMING','SCHEDULED','RELEASING') THEN 'upcoming' WHEN label IN ('LIVE','AVAILABLE') THEN 'live' WHEN label = 'IN_PROGRESS' THEN 'urgent' WHEN label IN ('ENDING_SOON','CLAIM_SOON') THEN 'soon' WHEN label = 'NEW' THEN 'info'
    WHEN label IN ('ENDED','EXPIRED','COMPLETED') THEN 'ended' WHEN label IN ('RELEASED','UNKNOWN') THEN 'neutral' END AS tone, label,
  CASE WHEN st = 'UPCOMING' THEN 'starts' WHEN st IN ('LIVE','ENDING_SOON') AND end_at IS NOT NULL THEN CASE WHEN type IN ('REWARD','REDEEM_CODE') THEN 'claim-by' ELSE 'ends' END END AS focus,
  CASE WHEN st = 'UPCOMING' THEN start_at WHEN st IN ('LIVE','ENDING_SOON') THEN end_at END AS focus_at
FROM l""",
    "status_over_time": f"""
WITH {ITEMS}, d AS (SELECT p.*, i.instant FROM pub p, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) i(instant))
SELECT instant, CASE WHEN start_at IS NULL AND end_at IS NULL THEN 'UNKNOWN' WHEN start_at > instant THEN 'UPCOMING' WHEN end_at <= instant THEN 'ENDED' WHEN type <> 'MAINTENANCE' AND end_at - instant <= INTERVAL 48 HOUR THEN 'ENDING_SOON' ELSE 'LIVE' END AS time_status, count(*) AS items
FROM d GROUP BY ALL""",
    "previous_reset": f"WITH {ALL_RULES} SELECT id AS rule_id, game_id, max(moment) AS previous_at FROM occ WHERE moment <= {NOW} GROUP BY ALL",
    "game_overview": f"WITH {ITEMS} SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY eff DESC, id)::INTEGER AS place, id FROM pub WHERE type = 'PATCH' QUALIFY place <= 3",
    "source_ranks": """
SELECT ['lol','lostark','maplestory','genshin','wuwa'][s_suppkey % 5 + 1] AS game_id, 's' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 7 THEN 'OFFICIAL_WEB' ELSE t END AS type
FROM (SELECT *, ['OFFICIAL_API','OFFICIAL_FEED','OFFICIAL_WEB','MANUAL','TRUSTED_FALLBACK','FIXTURE'][s_suppkey % 6 + 1] AS t FROM supplier) WHERE t <> 'FIXTURE' OR s_suppkey % 10 = 7""",
    "recorded_routes": r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS h FROM pages)
SELECT page_id, CASE WHEN url LIKE 'https://%' AND starts_with(url, 'https://' || h || '/') AND length(h) % 2 = 0 AND h <> '' THEN 200 WHEN starts_with(url, 'https://blog.a.example.net/') THEN 200 ELSE 404 END::INTEGER AS http_status,
  CASE WHEN starts_with(url, 'https://blog.a.example.net/') THEN 'blog' WHEN starts_with(url, 'https://' || h || '/') AND length(h) % 2 = 0 AND h <> '' THEN h ELSE 'not found' END AS body FROM p""",
    "robots_paths": r"""
WITH p AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS host, regexp_extract(url, '^https?://[^/]+(/[^#]*)', 1) AS path FROM pages)
SELECT host, path, CASE length(host) % 4 WHEN 0 THEN path NOT LIKE '/%' WHEN 1 THEN true WHEN 3 THEN true ELSE regexp_matches(path, '^/a.*e') OR NOT (starts_with(path, '/a') OR regexp_matches(path, '^/.*9$')) END AS allowed
FROM p WHERE host <> ''""",
    "stream_event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS rows FROM events GROUP BY ALL",
    "stream_ingest": ORACLE_SQL["store_after_batches"],
    "batch_counters": f"WITH {CHECKED}, {TWO_BATCHES} " + " UNION ALL ".join(
        f"SELECT {n} AS batch, count(*) AS discovered, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o.replace('-', '_')}" for o in ("created", "updated", "unchanged", "duplicate", "review-held", "rejected"))
        + ", " + ", ".join(f"count(*) FILTER (level = {i}) AS {v}" for i, v in enumerate(("valid", "warning", "review", "invalid"))) + f" FROM {t}_out" for n, t in enumerate("ab")
    ),
}

ORACLE_SQL.update(_FEEDS | _REST)
