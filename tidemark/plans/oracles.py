"""The registered queries as DuckDB SQL, written independently of the Spark expressions."""

from __future__ import annotations

from ..functions.recurrence import RESET_RULES

NOW = "TIMESTAMP '2024-01-16 00:00:00'"

ITEMS = f"""
items AS (
  SELECT event_id::VARCHAR AS id, event_id AS number, event_id::VARCHAR AS source_key,
    ['lol','lostark','maplestory','genshin','wuwa'][user_id % 5 + 1] AS game_id,
    ['PATCH','UPDATE','EVENT','REWARD','REDEEM_CODE','MAINTENANCE','BANNER','ANNOUNCEMENT'][event_id % 8 + 1] AS type,
    event_type || ' ' || (user_id % 40) AS title,
    CASE WHEN event_id % 13 <> 0 THEN ts END AS start_at,
    CASE WHEN event_id % 7 <> 0 THEN ts + to_hours(floor(value)::BIGINT) END AS end_at,
    CASE WHEN event_id % 5 <> 0 THEN ts - to_hours(event_id % 72) END AS source_published_at,
    ts AS published_at, ts AS updated_at, (event_id % 101)::INTEGER AS priority,
    CASE WHEN event_id % 11 = 0 THEN 'PENDING_REVIEW' ELSE 'PUBLISHED' END AS status,
    event_id % 3 = 0 AS is_synthetic,
    ['OFFICIAL_API','OFFICIAL_FEED','OFFICIAL_WEB','MANUAL','TRUSTED_FALLBACK','FIXTURE'][event_id % 6 + 1] AS source_type,
    (event_id % 6 + 1)::INTEGER AS authority
  FROM events
), timed AS (
  SELECT *, coalesce(start_at, source_published_at, published_at) AS eff,
    CASE WHEN start_at IS NULL AND end_at IS NULL THEN 'UNKNOWN' WHEN start_at > {NOW} THEN 'UPCOMING' WHEN end_at <= {NOW} THEN 'ENDED'
      WHEN type <> 'MAINTENANCE' AND end_at - {NOW} <= INTERVAL 48 HOUR THEN 'ENDING_SOON' ELSE 'LIVE' END AS st,
    CASE WHEN start_at IS NULL AND end_at IS NULL THEN 'UNKNOWN' WHEN start_at > {NOW} THEN 'SCHEDULED' WHEN end_at <= {NOW} THEN 'COMPLETED'
      WHEN end_at IS NULL AND {NOW} - start_at > INTERVAL 12 HOUR THEN 'UNKNOWN' ELSE 'IN_PROGRESS' END AS kept
  FROM items
), pub AS (SELECT * FROM timed WHERE status = 'PUBLISHED')"""

RULES = """
rules(id, game_id, frequency, off, h, dow, dom, is_primary) AS (VALUES
  ('lostark-daily','lostark','DAILY',9,6,NULL,NULL,false), ('lostark-weekly','lostark','WEEKLY',9,6,3,NULL,true),
  ('maplestory-daily','maplestory','DAILY',9,0,NULL,NULL,false), ('maplestory-weekly','maplestory','WEEKLY',9,0,4,NULL,true),
  ('maplestory-monthly','maplestory','MONTHLY',9,0,NULL,1,false), ('genshin-daily','genshin','DAILY',8,4,NULL,NULL,false),
  ('genshin-weekly','genshin','WEEKLY',8,4,1,NULL,true), ('genshin-spiral-abyss','genshin','CUSTOM_RRULE',8,4,NULL,16,false),
  ('genshin-imaginarium-theater','genshin','MONTHLY',8,4,NULL,1,false), ('wuwa-daily','wuwa','DAILY',8,4,NULL,NULL,false),
  ('wuwa-weekly','wuwa','WEEKLY',8,4,1,NULL,true)
), occ AS (
  SELECT r.*, d.day + to_hours(r.h) - to_hours(r.off) AS moment
  FROM rules r, generate_series(TIMESTAMP '2023-12-01', TIMESTAMP '2024-06-01', INTERVAL 1 DAY) d(day)
  WHERE (r.dow IS NULL OR isodow(d.day) = r.dow) AND (r.dom IS NULL OR day(d.day) = r.dom)
)"""

#: The usual rules and those of suppliers.
ALL_RULES = RULES.replace("rules(", "fixed(", 1).replace("), occ AS (", """), rules AS (SELECT * FROM fixed UNION ALL
  SELECT 's' || s_suppkey, ['lol','lostark','maplestory','genshin','wuwa'][s_suppkey % 5 + 1], ['DAILY','WEEKLY','MONTHLY'][s_suppkey % 3 + 1], 9, s_suppkey % 24, CASE WHEN s_suppkey % 3 = 1 THEN s_suppkey % 7 + 1 END, CASE WHEN s_suppkey % 3 = 2 THEN s_suppkey % 28 + 1 END, false FROM supplier
), occ AS (""", 1)

NEXT = f"nexts AS (SELECT id, game_id, is_primary, min(moment) AS next_at FROM occ WHERE moment > {NOW} GROUP BY ALL)"

URGENCY = f"""
urgent AS (
  SELECT *, CASE
    WHEN type = 'MAINTENANCE' THEN CASE kept WHEN 'IN_PROGRESS' THEN 1 WHEN 'SCHEDULED' THEN 8 ELSE 10 END
    WHEN st = 'ENDED' THEN 10
    WHEN st <> 'UPCOMING' AND end_at - {NOW} <= INTERVAL 6 HOUR THEN 2
    WHEN type IN ('REWARD','REDEEM_CODE') AND st IN ('LIVE','ENDING_SOON') THEN 3
    WHEN st <> 'UPCOMING' AND end_at - {NOW} <= INTERVAL 24 HOUR THEN 4
    WHEN type IN ('PATCH','UPDATE') AND eff <= {NOW} AND {NOW} - eff <= INTERVAL 3 DAY THEN 6
    WHEN type IN ('EVENT','BANNER') AND st = 'LIVE' AND {NOW} - start_at <= INTERVAL 3 DAY THEN 7
    WHEN st = 'UPCOMING' THEN 8 ELSE 9 END::INTEGER AS tier
  FROM pub
), reasoned AS (
  SELECT *, CASE tier WHEN 1 THEN 'MAINTENANCE_LIVE' WHEN 2 THEN 'EXPIRES_6H' WHEN 3 THEN 'CLAIMABLE_REWARD' WHEN 4 THEN 'EXPIRES_24H'
      WHEN 6 THEN 'NEW_PATCH' WHEN 7 THEN 'NEW_EVENT' WHEN 8 THEN 'UPCOMING' WHEN 9 THEN 'ONGOING' ELSE 'NONE' END AS reason,
    CASE WHEN tier IN (1,2,3,4,9) THEN end_at WHEN tier = 6 THEN eff WHEN tier IN (7,8) THEN start_at WHEN type <> 'MAINTENANCE' THEN end_at END AS moment
  FROM urgent
)"""

SECTIONS = f"""
sectioned AS (
  SELECT *, CASE
    WHEN type = 'MAINTENANCE' THEN CASE
      WHEN kept = 'IN_PROGRESS' THEN 'critical'
      WHEN kept = 'SCHEDULED' AND start_at - {NOW} <= INTERVAL 7 DAY THEN 'maintenance'
      WHEN kept = 'UNKNOWN' AND start_at IS NULL AND end_at IS NULL AND {NOW} - eff <= INTERVAL 48 HOUR THEN 'maintenance' END
    WHEN type IN ('PATCH','UPDATE') THEN CASE
      WHEN eff <= {NOW} AND {NOW} - eff <= INTERVAL 3 DAY THEN 'critical'
      WHEN start_at > {NOW} AND start_at - {NOW} <= INTERVAL 24 HOUR THEN 'critical'
      WHEN start_at > {NOW} AND start_at - {NOW} <= INTERVAL 7 DAY THEN 'upcoming' END
    WHEN type IN ('REWARD','REDEEM_CODE') THEN CASE
      WHEN st IN ('LIVE','ENDING_SOON') THEN 'rewards'
      WHEN st = 'UNKNOWN' AND {NOW} - eff <= INTERVAL 7 DAY THEN 'rewards'
      WHEN st = 'UPCOMING' AND start_at - {NOW} <= INTERVAL 7 DAY THEN 'upcoming' END
    WHEN type IN ('EVENT','BANNER') THEN CASE
      WHEN st = 'ENDING_SOON' THEN 'endingSoon'
      WHEN st = 'LIVE' AND {NOW} - start_at <= INTERVAL 3 DAY THEN 'newEvents'
      WHEN st = 'UPCOMING' AND start_at - {NOW} <= INTERVAL 7 DAY THEN 'upcoming' END
    WHEN {NOW} - eff <= INTERVAL 48 HOUR AND priority >= 80 THEN 'critical' END AS section
  FROM reasoned
), entries AS (
  SELECT section, 'item' AS kind, id, game_id, title, tier, reason, moment, priority FROM sectioned WHERE section IS NOT NULL
  UNION ALL
  SELECT 'resets', 'reset', id, game_id, id, CASE WHEN next_at - {NOW} <= INTERVAL 24 HOUR THEN 5 ELSE 8 END::INTEGER,
    CASE WHEN next_at - {NOW} <= INTERVAL 24 HOUR THEN 'RESET_24H' ELSE 'UPCOMING' END, next_at, CASE WHEN is_primary THEN 60 ELSE 50 END::INTEGER
  FROM nexts WHERE next_at - {NOW} <= INTERVAL 7 DAY
)"""

DIGEST = f"WITH {ITEMS}, {RULES}, {NEXT}, {URGENCY}, {SECTIONS}"
PLACED = "placed AS (SELECT section, kind, id, row_number() OVER (PARTITION BY section ORDER BY tier, moment NULLS LAST, priority DESC, title, id)::INTEGER AS place FROM entries)"

CANDIDATES = """
cand AS (
  SELECT 'src-' || (event_id % 6 + 1) AS source_id, (event_id % 6 + 1)::INTEGER AS authority,
    ['OFFICIAL_API','OFFICIAL_FEED','OFFICIAL_WEB','MANUAL','TRUSTED_FALLBACK','FIXTURE'][event_id % 6 + 1] AS source_type,
    (event_id % 997)::VARCHAR AS source_key,
    ['lol','lostark','maplestory','genshin','wuwa'][user_id % 5 + 1] AS game_id,
    ['PATCH','UPDATE','EVENT','REWARD','REDEEM_CODE','MAINTENANCE','BANNER','ANNOUNCEMENT'][event_id % 8 + 1] AS kind,
    event_type || ' ' || (user_id % 30) AS title, ts AS start_at, ts + to_hours(floor(value)::BIGINT - 5) AS end_at,
    event_id AS number, value, event_id % 3 = 0 AS is_synthetic
  FROM events
)"""

_UUID = "substr(x,1,8) || '-' || substr(x,9,4) || '-4' || substr(x,14,3) || '-' || substr('89ab', ('0x' || substr(x,17,1))::INTEGER % 4 + 1, 1) || substr(x,18,3) || '-' || substr(x,21,12)"

CHECKED = f"""
full_ AS (
  SELECT event_id AS number, event_id % 6 + 1 AS authority, 'src-' || (event_id % 6 + 1) AS source_id, event_id % 6 = 5 AS fixture, (event_id % 997)::VARCHAR AS source_key,
    ['lol','lostark','maplestory','genshin','wuwa'][user_id % 5 + 1] AS game_id, ['PATCH','UPDATE','EVENT','REWARD','REDEEM_CODE','MAINTENANCE','BANNER','ANNOUNCEMENT'][event_id % 8 + 1] AS kind,
    CASE WHEN event_id % 101 <> 0 THEN 'title' || (user_id % 3) ELSE '' END AS identity, event_type, user_id % 3 AS u, date_trunc('minute', ts) AS s, date_trunc('minute', ts) + to_hours(floor(value)::BIGINT - 5) AS e,
    CASE WHEN event_id % 8 = 4 AND event_id % 113 <> 0 THEN CASE WHEN event_id % 6 = 5 AND event_id % 3 <> 1 THEN 'GPTEST-' ELSE 'CODE' END || (event_id % 50) END AS code,
    (event_id % 6 = 5) <> (event_id % 109 = 0) AS synthetic, event_id % 4 = 1 AS ai
  FROM events
), formed AS (
  SELECT *, number % 101 = 0 OR number % 103 = 0 OR number % 107 = 0 OR (kind = 'REDEEM_CODE' AND code IS NULL) AS misshapen FROM full_
), checked AS (
  SELECT *, list_filter([
    CASE WHEN number % 101 = 0 THEN {{'code':'SCHEMA','severity':'INVALID','field':'title'}} END,
    CASE WHEN number % 103 = 0 THEN {{'code':'SCHEMA','severity':'INVALID','field':'source_url'}} END,
    CASE WHEN number % 107 = 0 THEN {{'code':'SCHEMA','severity':'INVALID','field':'priority'}} END,
    CASE WHEN kind = 'REDEEM_CODE' AND code IS NULL THEN {{'code':'SCHEMA','severity':'INVALID','field':'code'}} END,
    CASE WHEN NOT misshapen AND number % 29 = 0 AND game_id <> 'lol' THEN {{'code':'SOURCE_GAME_MISMATCH','severity':'INVALID','field':'gameId'}} END,
    CASE WHEN NOT misshapen AND kind = 'BANNER' THEN {{'code':'UNEXPECTED_CONTENT_TYPE','severity':'REVIEW','field':'kind'}} END,
    CASE WHEN NOT misshapen AND number % 13 = 0 THEN {{'code':'SOURCE_URL_HOST','severity':'REVIEW','field':'sourceUrl'}} END,
    CASE WHEN NOT misshapen AND number % 13 <> 0 AND number % 9 = 0 THEN {{'code':'SOURCE_URL_INSECURE','severity':'WARNING','field':'sourceUrl'}} END,
    CASE WHEN NOT misshapen AND e < s THEN {{'code':'END_BEFORE_START','severity':'INVALID','field':'endAt'}} END,
    CASE WHEN NOT misshapen AND e >= s AND e - s > INTERVAL 366 DAY THEN {{'code':'RANGE_TOO_LONG','severity':'REVIEW','field':'endAt'}} END,
    CASE WHEN NOT misshapen AND e >= s AND e < {NOW} THEN {{'code':'ALREADY_ENDED','severity':'WARNING','field':'endAt'}} END,
    CASE WHEN NOT misshapen AND number % 5 = 1 THEN {{'code':'TIMEZONE_UNKNOWN','severity':'WARNING','field':'timing.sourceTimezone'}} END,
    CASE WHEN NOT misshapen AND number % 15 = 0 AND number % 10 <> 0 THEN {{'code':'TIMEZONE_MISMATCH','severity':'INVALID','field':'startAt'}} END,
    CASE WHEN NOT misshapen AND fixture AND NOT synthetic THEN {{'code':'FIXTURE_NOT_SYNTHETIC','severity':'INVALID','field':'isSynthetic'}} END,
    CASE WHEN NOT misshapen AND NOT fixture AND synthetic THEN {{'code':'SYNTHETIC_FROM_REAL_SOURCE','severity':'INVALID','field':'isSynthetic'}} END,
    CASE WHEN NOT misshapen AND synthetic AND code LIKE 'CODE%' THEN {{'code':'SYNTHETIC_CODE_UNMARKED','severity':'INVALID','field':'code'}} END,
    CASE WHEN NOT misshapen AND kind = 'REDEEM_CODE' AND NOT synthetic AND number % 3 = 0 THEN {{'code':'CODE_WITHOUT_EVIDENCE','severity':'REVIEW','field':'redeemCode.code'}} END,
    CASE WHEN NOT misshapen AND ai AND number % 3 = 0 THEN {{'code':'AI_WITHOUT_EVIDENCE','severity':'REVIEW','field':NULL}} END,
    CASE WHEN NOT misshapen AND ai AND number % 3 = 1 THEN {{'code':'AI_FIELD_WITHOUT_EVIDENCE','severity':'REVIEW','field':'endAt'}} END,
    CASE WHEN NOT misshapen AND ai AND number % 3 = 2 AND number % 7 <> 0 THEN {{'code':'EVIDENCE_NOT_IN_SOURCE','severity':'REVIEW','field':'endAt'}} END
  ], lambda i: i IS NOT NULL) AS issues FROM formed
), decided AS (
  SELECT * EXCLUDE (x), {_UUID} AS own_id, CASE level WHEN 3 THEN NULL WHEN 2 THEN 'PENDING_REVIEW' ELSE 'PUBLISHED' END AS decision
  FROM (SELECT *, coalesce(list_max(list_transform(issues, lambda i: CASE i.severity WHEN 'WARNING' THEN 1 WHEN 'REVIEW' THEN 2 ELSE 3 END)), 0) AS level,
    sha256('content:' || source_id || ':' || source_key) AS x, concat_ws('|', kind, game_id, event_type, identity, u, s, e, code, number % 40, number % 107 = 0) AS content_hash,
    CASE WHEN kind = 'PATCH' THEN game_id || ':PATCH:1.' || (number % 40) WHEN code IS NOT NULL THEN game_id || ':REDEEM_CODE:' || code
      ELSE game_id || ':' || kind || ':' || identity || ':' || strftime(s, '%Y-%m-%d') END AS semantic_key FROM checked)
)"""


def _batch(name: str, where: str, stored: str = "") -> str:
    """A batch, candidate by candidate of each key, into a store (tables ``stored`` and ``prov``) or an empty one."""
    own = past = twin = "NULL"
    joins = ""
    if stored:
        joins = f"""
  LEFT JOIN stored o ON d.source_id = o.source_id AND d.source_key = o.source_key
  LEFT JOIN (SELECT p.source_id, p.source_key, arg_min(s, (s.authority, s.id)) AS past FROM prov p JOIN stored s ON p.id = s.id AND p.source_id <> s.source_id GROUP BY ALL) h ON d.source_id = h.source_id AND d.source_key = h.source_key
  LEFT JOIN (SELECT a.source_id, a.semantic_key, arg_min(s, (s.authority, s.id)) AS twin FROM (SELECT DISTINCT source_id, semantic_key FROM decided) a JOIN stored s ON a.semantic_key = s.semantic_key AND a.source_id <> s.source_id GROUP BY ALL) w ON d.source_id = w.source_id AND d.semantic_key = w.semantic_key"""
        own, past, twin = "o.id", "past", "twin"
    target = f"coalesce({past}, {twin})" if stored else "NULL"
    field = lambda f: f"({target}).{f}" if stored else "NULL"
    step = """CASE WHEN c.d IS NULL THEN 'rejected' WHEN e_out = 'duplicate' AND (o_id IS NOT NULL OR c.n >= e_n) THEN 'duplicate'
      WHEN s.d IS NULL AND (e_n IS NULL OR c.n < e_n) THEN 'review-held' WHEN s.d IS NULL THEN e_out
      WHEN s.h = c.h AND s.d = c.d THEN 'unchanged' WHEN s.d = 'PUBLISHED' AND c.d = 'PENDING_REVIEW' THEN 'review-held' ELSE 'updated' END"""
    return f"""
{name}_in AS (SELECT d.*, {own}::VARCHAR AS o_id, {'o.content_hash' if stored else 'NULL'}::VARCHAR AS o_hash, {'o.status' if stored else 'NULL'}::VARCHAR AS o_status, {past} IS NULL AS free,
    {field('id')}::VARCHAR AS g_id, {field('authority')}::BIGINT AS g_authority, {field('status')}::VARCHAR AS g_status
  FROM decided d {joins} WHERE {where}),
{name}_first AS (SELECT * FROM {name}_in WHERE decision IS NOT NULL AND o_id IS NULL AND NOT coalesce(authority < g_authority AND g_status = 'PUBLISHED' AND decision = 'PENDING_REVIEW', false)
  QUALIFY row_number() OVER (PARTITION BY source_id, source_key ORDER BY number) = 1),
{name}_lead AS (SELECT semantic_key, min((authority, source_id)) AS l_place, arg_min(source_id, (authority, source_id)) AS l_source, arg_min(own_id, (authority, source_id, source_key)) AS l_id, arg_min(coalesce(g_id, own_id), (authority, source_id, source_key)) AS l_record
  FROM {name}_first WHERE free AND (g_id IS NULL OR authority < g_authority) GROUP BY 1),
{name}_early AS (SELECT i.source_id, i.source_key, min(number) AS n, any_value(authority) AS h_authority, any_value(own_id) AS h_id FROM {name}_in i JOIN {name}_lead l ON i.semantic_key = l.semantic_key
  WHERE decision = 'PENDING_REVIEW' AND o_id IS NULL AND free AND g_status = 'PUBLISHED' AND authority < g_authority AND l_source = i.source_id AND l_id <> own_id GROUP BY 1, 2),
{name}_usual AS (SELECT source_id, source_key, authority, number, own_id,
    CASE WHEN free AND l_place < (authority, source_id) THEN 'duplicate' WHEN g_id IS NULL THEN 'created' WHEN authority >= g_authority THEN 'duplicate' WHEN NOT free OR l_id = own_id THEN 'updated' ELSE 'created' END AS e_out,
    CASE WHEN free AND l_place < (authority, source_id) THEN l_record WHEN g_id IS NULL THEN own_id WHEN authority >= g_authority OR NOT free OR l_id = own_id THEN g_id ELSE own_id END AS e_owner
  FROM {name}_first LEFT JOIN {name}_lead USING (semantic_key)),
{name}_came AS (SELECT source_id, source_key, coalesce(authority, h_authority) AS authority, least(number, n) AS number, coalesce(own_id, h_id) AS own_id,
    CASE WHEN n < number OR number IS NULL THEN 'created' ELSE e_out END AS e_out, CASE WHEN n < number OR number IS NULL THEN h_id ELSE e_owner END AS e_owner FROM {name}_usual FULL JOIN {name}_early USING (source_id, source_key)),
{name}_won AS (SELECT e_owner AS record, arg_min(source_id, (authority, source_id, source_key)) AS w_source, arg_min(source_key, (authority, source_id, source_key)) AS w_key FROM {name}_came WHERE e_out = 'updated' GROUP BY 1),
{name}_entry AS (SELECT source_id, source_key, number AS e_n, CASE WHEN e_out <> 'updated' OR (w_source, w_key) = (source_id, source_key) THEN e_out WHEN w_source = source_id THEN 'created' ELSE 'duplicate' END AS e_out,
    CASE WHEN e_out = 'updated' AND w_source = source_id AND w_key <> source_key THEN own_id ELSE e_owner END AS e_owner
  FROM {name}_came LEFT JOIN {name}_won ON e_owner = record
  {f"UNION ALL SELECT source_id, source_key, NULL, 'duplicate', record FROM stored JOIN {name}_won ON id = record" if stored else ""}),
{name}_keys AS (SELECT source_id, source_key, o_id, any_value(o_hash) AS o_hash, any_value(o_status) AS o_status, list({{'n': number, 'h': content_hash, 'd': decision, 'g': g_id, 'out': []::VARCHAR[]}} ORDER BY number) AS said FROM {name}_in GROUP BY 1, 2, 3),
{name}_folded AS (SELECT source_id, source_key, o_id, e_n, e_owner, said, list_reduce(list_prepend({{'n': NULL, 'h': o_hash, 'd': o_status, 'g': NULL, 'out': []::VARCHAR[]}}, said), lambda s, c: {{
    'n': c.n, 'h': CASE WHEN ({step}) IN ('created', 'updated') THEN c.h ELSE s.h END, 'd': CASE WHEN ({step}) IN ('created', 'updated') THEN c.d ELSE s.d END, 'g': c.g, 'out': list_append(s.out, {step})}}).out AS outs
  FROM {name}_keys LEFT JOIN {name}_entry USING (source_id, source_key)),
{name}_one AS (SELECT o_id, e_n, e_owner, unnest(said) AS c, unnest(outs) AS outcome FROM {name}_folded),
{name}_out AS (SELECT d.*, outcome, CASE WHEN decision IS NOT NULL THEN CASE WHEN o_id IS NULL AND (e_n IS NULL OR number < e_n) THEN c.g ELSE coalesce(e_owner, o_id) END END AS owner FROM {name}_one JOIN decided d ON c.n = number),
{name}_won_last AS (SELECT owner AS id, arg_min({{'source_id': source_id, 'source_key': source_key, 'authority': authority, 'semantic_key': semantic_key, 'content_hash': content_hash, 'status': decision}}, (authority, -number)) AS w FROM {name}_out WHERE outcome IN ('created', 'updated') GROUP BY 1),
{name}_named AS (SELECT owner AS id, source_id, source_key, bool_or(outcome <> 'duplicate') AS owns FROM {name}_out WHERE outcome IN ('created', 'updated', 'unchanged', 'duplicate') GROUP BY ALL)"""


#: A batch before now into an empty store, then the rest into that store.
TWO_BATCHES = f"""{_batch("a", f"s < {NOW}")},
stored AS (SELECT id, w.* FROM a_won_last),
prov AS (SELECT id, source_id, source_key, owns AS is_primary FROM a_named),
{_batch("b", f"(s < {NOW}) IS NOT TRUE", "stored")},
records AS (SELECT coalesce(w.source_id, s.source_id) AS source_id, coalesce(w.status, s.status) AS status FROM stored s FULL JOIN b_won_last USING (id)),
roles AS (SELECT source_id, CASE WHEN n.owns THEN 'PRIMARY' WHEN id IN (SELECT id FROM b_named WHERE owns) THEN 'SUPPORTING' WHEN p.is_primary THEN 'PRIMARY' ELSE 'SUPPORTING' END AS role FROM prov p FULL JOIN b_named n USING (id, source_id, source_key))"""


ISSUES = f"""
facts AS (
  SELECT number, kind, source_type, is_synthetic, value,
    CASE WHEN number % 29 = 0 THEN 'lol' ELSE game_id END <> game_id AS other_game,
    number % 4 <> 2 AS allowed, number % 9 = 0 AS insecure,
    CASE WHEN number % 7 <> 0 THEN end_at + to_days((CASE WHEN number % 17 = 0 THEN 400 ELSE 0 END)::INTEGER) END AS e,
    CASE WHEN number % 13 <> 0 THEN start_at + to_days((CASE WHEN number % 19 = 0 THEN 800 ELSE 0 END)::INTEGER) END AS s
  FROM cand
), issues AS (
  SELECT number, source_type, unnest(list_filter([
    CASE WHEN other_game THEN {{'code':'SOURCE_GAME_MISMATCH','severity':'INVALID','field':'gameId'}} END,
    CASE WHEN kind NOT IN ('PATCH','EVENT','REWARD','MAINTENANCE') THEN {{'code':'UNEXPECTED_CONTENT_TYPE','severity':'REVIEW','field':'kind'}} END,
    CASE WHEN NOT allowed THEN {{'code':'SOURCE_URL_HOST','severity':'REVIEW','field':'sourceUrl'}} END,
    CASE WHEN allowed AND insecure THEN {{'code':'SOURCE_URL_INSECURE','severity':'WARNING','field':'sourceUrl'}} END,
    CASE WHEN e < s THEN {{'code':'END_BEFORE_START','severity':'INVALID','field':'endAt'}} END,
    CASE WHEN NOT coalesce(e < s, false) AND e - s > INTERVAL 366 DAY THEN {{'code':'RANGE_TOO_LONG','severity':'REVIEW','field':'endAt'}} END,
    CASE WHEN NOT coalesce(e < s, false) AND s - {NOW} > INTERVAL 732 DAY THEN {{'code':'START_TOO_FAR','severity':'REVIEW','field':'startAt'}} END,
    CASE WHEN NOT coalesce(e < s, false) AND e < {NOW} THEN {{'code':'ALREADY_ENDED','severity':'WARNING','field':'endAt'}} END,
    CASE WHEN NOT coalesce(e < s, false) AND kind IN ('EVENT','BANNER','REWARD','REDEEM_CODE') AND e IS NULL THEN {{'code':'END_MISSING','severity':'WARNING','field':'endAt'}} END,
    CASE WHEN NOT coalesce(e < s, false) AND kind = 'MAINTENANCE' AND s IS NULL THEN {{'code':'START_MISSING','severity':'WARNING','field':'startAt'}} END,
    CASE WHEN value * (CASE WHEN number % 23 = 0 THEN 1e9 ELSE 1 END) > 10000000 THEN {{'code':'REWARD_QUANTITY_IMPLAUSIBLE','severity':'REVIEW','field':'items'}} END,
    CASE WHEN source_type = 'FIXTURE' AND NOT is_synthetic THEN {{'code':'FIXTURE_NOT_SYNTHETIC','severity':'INVALID','field':'isSynthetic'}} END,
    CASE WHEN source_type <> 'FIXTURE' AND is_synthetic THEN {{'code':'SYNTHETIC_FROM_REAL_SOURCE','severity':'INVALID','field':'isSynthetic'}} END,
    CASE WHEN is_synthetic AND kind = 'REDEEM_CODE' AND number % 2 <> 0 THEN {{'code':'SYNTHETIC_CODE_UNMARKED','severity':'INVALID','field':'code'}} END
  ], lambda x: x IS NOT NULL)) AS i
  FROM facts
), worst AS (
  SELECT c.number, c.source_type, ['VALID','WARNING','REVIEW','INVALID'][coalesce(max(CASE i.severity WHEN 'WARNING' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'INVALID' THEN 3 END), 0) + 1] AS status
  FROM cand c LEFT JOIN issues USING (number) GROUP BY ALL
)"""

PARTS = """
prev AS (SELECT * FROM part WHERE p_partkey % 10 <> 0),
cur AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice + 1, 2) ELSE p_retailprice END AS p_retailprice,
  CASE WHEN p_partkey % 7 = 0 THEN p_size - 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 1)"""

RAW = """
raw AS (
  SELECT source AS source_id, doc_id::VARCHAR AS document_key, sha256(text || CASE WHEN f = 1 AND doc_id % 10 = 0 THEN ' changed' ELSE '' END) AS content_hash,
    TIMESTAMP '2024-01-01' + to_hours(doc_id % 1000 + f) AS fetched_at
  FROM documents, (VALUES (0), (1)) t(f)
)"""

_LINES = """lines AS (
  SELECT l_orderkey AS patch_id, l_linenumber AS position, l_returnflag AS target_type, l_extendedprice AS before, round(l_extendedprice * (1 - l_discount), 4) AS after
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({s}, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
ORACLE_SQL = {
    "content_window_query": f"""WITH {ITEMS} SELECT id, game_id, type, title, start_at, end_at, eff AS effective_at FROM pub
WHERE game_id IN ('lol','genshin') AND NOT is_synthetic AND CASE WHEN type IN ('PATCH','UPDATE','ANNOUNCEMENT') OR (start_at IS NULL AND end_at IS NULL)
  THEN eff BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'
  ELSE coalesce(end_at >= TIMESTAMP '2024-01-10', true) AND coalesce(start_at <= TIMESTAMP '2024-01-20', true) END""",
    "content_recent": f"WITH {ITEMS} SELECT id, type, eff AS effective_at FROM pub ORDER BY eff DESC, id LIMIT 50",
    "time_status_counts": f"WITH {ITEMS} SELECT game_id, type, st AS time_status, count(*) AS items FROM timed GROUP BY ALL",
    "reward_state_counts": f"""WITH {ITEMS} SELECT game_id, state, state IN ('AVAILABLE','ENDING_SOON') AS claimable, count(*) AS items FROM (
SELECT game_id, CASE st WHEN 'LIVE' THEN 'AVAILABLE' WHEN 'ENDED' THEN 'EXPIRED' ELSE st END AS state FROM pub WHERE type IN ('REWARD','REDEEM_CODE')) GROUP BY ALL""",
    "maintenance_state_counts": f"WITH {ITEMS} SELECT game_id, kept AS state, count(*) AS items FROM pub WHERE type = 'MAINTENANCE' GROUP BY ALL",
    "item_urgency": f"WITH {ITEMS}, {URGENCY} SELECT id, tier, reason, moment FROM reasoned",
    "today_sections": f"{DIGEST} SELECT section, kind, id, game_id, tier, reason, moment, priority FROM entries",
    "today_places": f"""{DIGEST}, named AS (SELECT * REPLACE (CASE id WHEN 'lostark-daily' THEN '일일 초기화' WHEN 'maplestory-daily' THEN '일일 초기화' WHEN 'genshin-daily' THEN '일일 초기화' WHEN 'wuwa-daily' THEN '일일 초기화'
  WHEN 'lostark-weekly' THEN '주간 초기화' WHEN 'genshin-weekly' THEN '주간 초기화' WHEN 'wuwa-weekly' THEN '주간 초기화' WHEN 'maplestory-weekly' THEN '주간 보스·콘텐츠 초기화'
  WHEN 'genshin-spiral-abyss' THEN '나선 비경 갱신' ELSE title END AS title) FROM entries)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY tier, moment NULLS LAST, priority DESC, title, id)::INTEGER AS place, id FROM named QUALIFY place <= 20""",
    "today_summary": f"""{DIGEST} SELECT *, updates + rewards + resets + ending_soon AS total FROM (
SELECT count(*) FILTER (section = 'critical') AS updates, count(*) FILTER (section = 'rewards') AS rewards,
  count(*) FILTER (section = 'resets' AND reason = 'RESET_24H') AS resets, count(*) FILTER (section = 'endingSoon') AS ending_soon FROM entries)""",
    "timeline_groups": f"""WITH {ITEMS}, grouped AS (SELECT *, coalesce(end_at, eff) AS closed, CASE
  WHEN type = 'MAINTENANCE' THEN CASE WHEN kept = 'IN_PROGRESS' THEN 'current' WHEN kept = 'SCHEDULED' THEN 'upcoming' WHEN kept = 'COMPLETED' THEN 'recent' WHEN start_at <= {NOW} THEN 'recent' END
  WHEN type IN ('PATCH','UPDATE','ANNOUNCEMENT') OR (start_at IS NULL AND end_at IS NULL) THEN CASE WHEN eff > {NOW} THEN 'upcoming' ELSE 'recent' END
  WHEN st IN ('LIVE','ENDING_SOON') THEN 'current' WHEN st = 'UPCOMING' THEN 'upcoming' WHEN st = 'ENDED' THEN 'recent' END AS timeline FROM pub),
ranked AS (SELECT timeline, game_id, id, row_number() OVER (PARTITION BY timeline, game_id ORDER BY CASE timeline WHEN 'current' THEN epoch_us(end_at) WHEN 'upcoming' THEN epoch_us(eff) ELSE -epoch_us(closed) END NULLS LAST, id)::INTEGER AS place
  FROM grouped WHERE timeline IS NOT NULL AND NOT (timeline = 'upcoming' AND eff - {NOW} > INTERVAL 60 DAY) AND NOT (timeline = 'recent' AND {NOW} - closed > INTERVAL 30 DAY))
SELECT timeline, game_id, place, id FROM ranked WHERE timeline <> 'recent' OR place <= 10""",
    "pulse_stream": f"""WITH {ITEMS}, {RULES}, moments AS (
  SELECT id, game_id, type AS kind, CASE type WHEN 'REWARD' THEN coalesce(start_at, source_published_at, published_at) WHEN 'REDEEM_CODE' THEN coalesce(source_published_at, published_at, start_at)
    WHEN 'MAINTENANCE' THEN start_at WHEN 'ANNOUNCEMENT' THEN coalesce(source_published_at, published_at) ELSE eff END AS moment FROM pub WHERE type NOT IN ('EVENT','BANNER')
  UNION ALL SELECT id, game_id, type || '_START', start_at FROM pub WHERE type IN ('EVENT','BANNER')
  UNION ALL SELECT id, game_id, CASE type WHEN 'EVENT' THEN 'EVENT_ENDING' ELSE 'BANNER_END' END, end_at FROM pub WHERE type IN ('EVENT','BANNER'))
SELECT id || ':' || kind AS id, kind, moment, game_id, moment > {NOW} AS is_future FROM moments WHERE moment BETWEEN {NOW} - INTERVAL 48 HOUR AND {NOW} + INTERVAL 48 HOUR
UNION ALL
SELECT id || ':RESET:' || strftime(moment, '%Y-%m-%dT%H:%M:%S.000Z'), 'RESET', moment, game_id, moment > {NOW} FROM occ WHERE frequency <> 'DAILY' AND moment >= {NOW} - INTERVAL 48 HOUR AND moment < {NOW} + INTERVAL 48 HOUR""",
    "game_snapshot": f"""WITH {ITEMS}, {RULES}, {NEXT}, facts AS (SELECT game_id,
  (array_agg(id ORDER BY eff DESC, number) FILTER (type = 'PATCH' AND eff <= {NOW}))[1] AS latest_patch,
  (array_agg(id ORDER BY start_at, number) FILTER (type = 'PATCH' AND st = 'UPCOMING'))[1] AS next_patch,
  count(*) FILTER (type IN ('REWARD','REDEEM_CODE') AND st IN ('LIVE','ENDING_SOON')) AS rewards_available,
  count(*) FILTER (type = 'EVENT' AND st IN ('LIVE','ENDING_SOON')) AS current_events,
  (array_agg(id ORDER BY end_at, number) FILTER (type = 'EVENT' AND st = 'ENDING_SOON'))[1] AS ending_soon_event,
  (array_agg(id ORDER BY end_at NULLS LAST, number) FILTER (type = 'BANNER' AND st IN ('LIVE','ENDING_SOON')))[1] AS current_banner,
  (array_agg(id ORDER BY kept, coalesce(epoch_us(start_at), 0), number) FILTER (type = 'MAINTENANCE' AND (kept = 'IN_PROGRESS' OR (kept = 'SCHEDULED' AND start_at - {NOW} <= INTERVAL 3 DAY))))[1] AS maintenance,
  max(updated_at) AS last_updated_at FROM pub GROUP BY game_id),
resets AS (SELECT game_id, (array_agg(id ORDER BY NOT is_primary, next_at, id))[1] AS primary_reset, (array_agg(next_at ORDER BY NOT is_primary, next_at, id))[1] AS primary_at,
  array_to_string((array_agg(id ORDER BY next_at, id))[1:3], ',') AS next_resets FROM nexts GROUP BY game_id)
SELECT * FROM facts LEFT JOIN resets USING (game_id)""",
    "dashboard_items": f"""WITH {ITEMS}, latest AS (SELECT id FROM pub WHERE type = 'PATCH' AND start_at <= {NOW} QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY start_at DESC, number) = 1)
SELECT id, game_id, type FROM pub WHERE id IN (SELECT id FROM latest) OR CASE WHEN end_at IS NOT NULL THEN end_at >= {NOW} - INTERVAL 35 DAY ELSE eff >= {NOW} - INTERVAL 21 DAY OR type IN ('EVENT','BANNER') END""",
    "calendar_month": f"""WITH {ITEMS}, {RULES}, days AS (SELECT d::DATE AS day, (date_diff('day', DATE '2023-12-31', d::DATE) // 7)::INTEGER AS week, month(d) = 1 AS in_month, d::DATE = DATE '2024-01-16' AS is_today
  FROM generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) t(d)),
marks AS (SELECT 'RELEASE' AS marker, coalesce(start_at, source_published_at) AS moment FROM pub WHERE type IN ('PATCH','UPDATE')
  UNION ALL SELECT 'START', start_at FROM pub WHERE type IN ('EVENT','BANNER','REWARD','REDEEM_CODE','MAINTENANCE')
  UNION ALL SELECT 'END', end_at FROM pub WHERE type IN ('EVENT','BANNER','REWARD','REDEEM_CODE','MAINTENANCE')
  UNION ALL SELECT 'RESET', moment FROM occ WHERE frequency <> 'DAILY'),
local AS (SELECT marker, (moment + INTERVAL 9 HOUR)::DATE AS day FROM marks)
SELECT day, week, in_month, is_today, count(*) FILTER (marker = 'START') AS n_start, count(*) FILTER (marker = 'END') AS n_end, count(*) FILTER (marker = 'RELEASE') AS n_release, count(*) FILTER (marker = 'RESET') AS n_reset
FROM days LEFT JOIN local USING (day) GROUP BY ALL""",
    "reset_occurrences": f"WITH {ALL_RULES} SELECT id AS rule_id, game_id, moment FROM occ WHERE moment >= TIMESTAMP '2024-01-01' AND moment < TIMESTAMP '2024-03-01'",
    "next_reset": f"WITH {ALL_RULES}, {NEXT} SELECT id AS rule_id, game_id, next_at FROM nexts",
    "patch_changes": f"WITH {_LINES} SELECT patch_id, position, target_type, CASE WHEN after < before THEN 'BUFF' WHEN after > before THEN 'NERF' ELSE 'ADJUST' END AS change, before, after FROM lines",
    "change_groups": f"""WITH {_LINES}, g AS (SELECT patch_id, target_type, min(position) AS first_position, count(*) AS changes FROM lines GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY first_position, target_type)::INTEGER AS place FROM g""",
    "snapshot_diff": f"""WITH {PARTS}, both_sides AS (SELECT coalesce(c.p_partkey, p.p_partkey) AS p_partkey, coalesce(c.p_name, p.p_name) AS p_name, p.p_partkey IS NULL AS is_new, c.p_partkey IS NULL AS gone,
  p.p_retailprice AS p1, c.p_retailprice AS c1, p.p_size::DOUBLE AS p2, c.p_size::DOUBLE AS c2 FROM prev p FULL JOIN cur c ON p.p_partkey = c.p_partkey)
SELECT p_partkey, p_name AS name, NULL::VARCHAR AS field, CASE WHEN is_new THEN 'NEW' ELSE 'REMOVED' END AS change, NULL::DOUBLE AS before, NULL::DOUBLE AS after FROM both_sides WHERE is_new OR gone
UNION ALL SELECT p_partkey, p_name, 'p_retailprice', CASE WHEN c1 < p1 THEN 'BUFF' ELSE 'NERF' END, p1, c1 FROM both_sides WHERE NOT is_new AND NOT gone AND p1 <> c1
UNION ALL SELECT p_partkey, p_name, 'p_size', CASE WHEN c2 > p2 THEN 'BUFF' ELSE 'NERF' END, p2, c2 FROM both_sides WHERE NOT is_new AND NOT gone AND p2 <> c2""",
    "raw_change_detection": f"""WITH {RAW} SELECT source_id, document_key, fetched_at, content_hash, CASE WHEN b IS NULL THEN 'new' WHEN b = content_hash THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT *, lag(content_hash) OVER (PARTITION BY source_id, document_key ORDER BY fetched_at, content_hash) AS b FROM raw)""",
    "latest_raw_document": f"WITH {RAW} SELECT source_id, document_key, content_hash, fetched_at FROM raw QUALIFY row_number() OVER (PARTITION BY source_id, document_key ORDER BY fetched_at DESC, content_hash DESC) = 1",
    "candidate_issues": f"WITH {CHECKED}, i AS (SELECT number, unnest(issues) AS i FROM checked) SELECT number, i.code, i.severity, i.field FROM i",
    "publish_outcomes": f"WITH {CHECKED}, {_batch('a', 'true')} SELECT source_id, source_key, number, outcome, owner FROM a_out",
    "publish_second_batch": f"WITH {CHECKED}, {TWO_BATCHES} SELECT source_id, source_key, number, outcome, owner FROM b_out",
    "store_after_batches": f"""WITH {CHECKED}, {TWO_BATCHES} SELECT 'record' AS of, source_id, status, count(*) AS rows FROM records GROUP BY ALL
UNION ALL SELECT 'sighting', source_id, role, count(*) FROM roles GROUP BY ALL""",
    "authority_dedupe": f"""WITH {CHECKED} SELECT semantic_key, (array_agg(source_id ORDER BY authority, source_id, source_key, number))[1] AS source_id, (array_agg(source_key ORDER BY authority, source_id, source_key, number))[1] AS source_key, count(*) AS candidates
FROM decided WHERE decision IS NOT NULL GROUP BY semantic_key""",
    "provenance_rollup": f"""WITH {CANDIDATES}, rolled AS (SELECT game_id || ':' || kind || ':' || title AS content_id, source_id, source_key, min(start_at) AS first_seen, max(start_at) AS last_seen, count(*) AS sightings, min(authority) AS a FROM cand GROUP BY ALL)
SELECT * EXCLUDE (a), CASE WHEN row_number() OVER (PARTITION BY content_id ORDER BY a, first_seen, source_id, source_key) = 1 THEN 'PRIMARY' ELSE 'SUPPORTING' END AS role FROM rolled""",
    "ttl_expiry": f"WITH {CANDIDATES} SELECT number, source_id FROM cand WHERE start_at < {NOW} - to_days(CASE source_id WHEN 'src-1' THEN 3 WHEN 'src-3' THEN 7 WHEN 'src-5' THEN 14 END)",
    "raw_text_retention": f"WITH {RAW} SELECT source_id, count(*) FILTER (fetched_at >= TIMESTAMP '2024-01-20') AS kept, count(*) FILTER (fetched_at < TIMESTAMP '2024-01-20') AS pruned FROM raw GROUP BY ALL",
    "validation_issues": f"WITH {CANDIDATES}, {ISSUES} SELECT number, i.code, i.severity, i.field FROM issues",
    "validation_worst_status": f"WITH {CANDIDATES}, {ISSUES} SELECT source_type, status, count(*) AS candidates FROM worst GROUP BY ALL",
    "publication_decision": f"""WITH {CANDIDATES}, {ISSUES}, p AS (SELECT *, ['deterministic','ai','manual','fixture'][number % 4 + 1] AS parser FROM worst)
SELECT number, CASE WHEN status = 'INVALID' THEN NULL WHEN status = 'REVIEW' THEN 'PENDING_REVIEW' ELSE 'PUBLISHED' END AS status,
  CASE WHEN status = 'INVALID' THEN NULL WHEN status = 'REVIEW' THEN 'UNVERIFIED' WHEN source_type = 'MANUAL' THEN CASE WHEN parser = 'ai' THEN 'UNVERIFIED' ELSE 'MANUAL_VERIFIED' END
    WHEN source_type LIKE 'OFFICIAL%' AND parser IN ('deterministic','ai') THEN 'AUTO_VERIFIED' ELSE 'UNVERIFIED' END AS verification FROM p""",
    "patch_change_issues": """WITH v AS (SELECT l_returnflag, l_partkey AS k, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity::INTEGER END AS b, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity::INTEGER + l_partkey % 2 END AS a FROM lineitem)
SELECT l_returnflag, 'PATCH_VALUE_UNCHANGED' AS code, count(*) AS issues FROM v WHERE a = b GROUP BY ALL
UNION ALL SELECT l_returnflag, 'PATCH_VALUE_HALF_PAIR', count(*) FROM v WHERE (a IS NULL) <> (b IS NULL) AND k % 11 <> 0 GROUP BY ALL
UNION ALL SELECT l_returnflag, 'PATCH_CHANGE_EMPTY', count(*) FROM v WHERE a IS NULL AND b IS NULL AND k % 3 = 0 AND k % 2 <> 0 GROUP BY ALL""",
    "host_allowlist": r"""WITH h AS (SELECT page_id, lower(regexp_extract(replace(url, chr(92), '/'), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[0-9a-fA-F:.]+\]|[^/@:?#\s%]+)(?::[0-9]*)?(?:[/?#]|$)', 1)) AS host FROM pages)
SELECT page_id, host, host <> '' AND (host IN ('example.net','example.org') OR host LIKE '%.example.net' OR host LIKE '%.example.org') AS allowed FROM h""",
    "page_text": r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<noscript\b[^>]*>.*?</noscript\s*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<svg\b[^>]*>.*?</svg\s*>|<template\b[^>]*>.*?</template\s*>', ' ', 'g'),
    '(?i)</?(article|blockquote|br|div|footer|h[1-6]|header|li|ol|p|pre|section|table|tr|ul)([^a-z0-9>][^>]*)?>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS x FROM pages),
d AS (SELECT page_id, replace(replace(replace(replace(x, '&quot;', '"'), '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&') AS x FROM t),
l AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(x, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), chr(10)), lambda y: trim(regexp_replace(y, '[ \t]+', ' ', 'g'))), lambda y: y <> ''), chr(10)) AS x FROM d)
SELECT page_id, x AS text, length(x)::INTEGER AS n_chars, CASE WHEN length(replace(x, chr(10), ' ')) > 160 THEN rtrim(substr(replace(x, chr(10), ' '), 1, 159)) || '…' ELSE replace(x, chr(10), ' ') END AS summary FROM l""",
    "evidence_in_source": r"""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents), b AS (SELECT item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS p FROM benchmark)
SELECT DISTINCT doc_id, item_id FROM d JOIN b ON contains(t, p)""",
    "title_identity": f"WITH {ITEMS} SELECT id, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS identity, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM items",
    "semantic_keys": f"""WITH {ITEMS} SELECT id, CASE type WHEN 'PATCH' THEN game_id || ':PATCH:1.' || id WHEN 'REDEEM_CODE' THEN game_id || ':REDEEM_CODE:CODE-' || id
ELSE game_id || ':' || type || ':' || regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') || ':' || coalesce(strftime(start_at, '%Y-%m-%d'), 'na') END AS semantic_key FROM items""",
    "content_ids": f"""WITH {ITEMS}, hashed AS (SELECT id, sha256('content:' || source_type || ':' || source_key) AS x, {_FNV.format(s="title")} AS f FROM items)
SELECT id, {_UUID} AS content_id, lpad(lower(to_hex(f)), 8, '0') AS fnv FROM hashed""",
    "slug_assignment": f"""WITH {ITEMS}, s AS (SELECT id, regexp_replace(lower(game_id || ' ' || type || ' ' || title), '[^a-z0-9]+', '-', 'g') AS slug FROM items),
r AS (SELECT id, slug, row_number() OVER (PARTITION BY slug ORDER BY id) AS n, {_FNV.format(s="id")} AS f FROM s)
SELECT id, CASE WHEN n = 1 THEN slug ELSE substr(slug, 1, 110) || '-' || lpad(lower(to_hex(f)), 8, '0') END AS slug FROM r""",
    "registry_sync": f"""WITH {PARTS} SELECT CASE WHEN p.p_partkey IS NULL THEN 'created' WHEN p.p_name = c.p_name AND p.p_retailprice = c.p_retailprice AND p.p_size = c.p_size THEN 'unchanged' ELSE 'updated' END AS action, count(*) AS parts
FROM cur c LEFT JOIN prev p ON p.p_partkey = c.p_partkey GROUP BY ALL""",
    "durations_and_labels": f"""WITH {ITEMS}, x AS (SELECT id, start_at, published_at AS moment, greatest(floor((epoch_us(published_at) - epoch_us({NOW})) / 1000000), 0)::BIGINT AS s, greatest(floor((epoch_us({NOW}) - epoch_us(published_at)) / 1000000), 0)::BIGINT AS ago_s,
  date_diff('day', DATE '2024-01-16', (published_at + INTERVAL 9 HOUR)::DATE) AS dd FROM items),
y AS (SELECT *, CASE WHEN s // 3600 < 100 THEN lpad((s // 3600)::VARCHAR, 2, '0') ELSE (s // 3600)::VARCHAR END || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock,
  CASE WHEN dd = 0 THEN 'D-DAY' WHEN dd > 0 THEN 'D-' || dd ELSE 'D+' || (-dd) END AS d_day FROM x)
SELECT id, clock, d_day, CASE WHEN moment <= {NOW} THEN NULL WHEN s < 86400 THEN clock ELSE d_day END AS remaining,
  CASE WHEN ago_s < 60 THEN 'just now' WHEN ago_s < 3600 THEN (ago_s // 60) || 'm ago' WHEN ago_s < 86400 THEN (ago_s // 3600) || 'h ago' ELSE (ago_s // 86400) || 'd ago' END AS ago,
  ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][isodow(moment + INTERVAL 9 HOUR)] AS weekday, coalesce(strftime(start_at, '%Y-%m-%d'), 'na') AS utc_day FROM y""",
    "last_updated": f"WITH {ITEMS} SELECT game_id, max(updated_at) AS last_updated_at FROM pub GROUP BY game_id",
    "run_report": f"""WITH {CHECKED}, {_batch("a", "true")}, c AS (SELECT source_id, count(*) AS discovered, count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'duplicate') AS duplicate, count(*) FILTER (outcome = 'review-held') AS review_held,
  count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (level = 0) AS valid, count(*) FILTER (level = 1) AS warning, count(*) FILTER (level = 2) AS review, count(*) FILTER (level = 3) AS invalid FROM a_out GROUP BY source_id)
SELECT *, CASE WHEN rejected = 0 THEN 'SUCCEEDED' WHEN created + duplicate > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS run_status FROM c""",
    "home_highlights": f"""{DIGEST}, {PLACED} SELECT section, place, id FROM placed WHERE kind = 'item' AND section NOT IN ('resets','upcoming')
ORDER BY list_position(['critical','rewards','resets','endingSoon','newEvents','maintenance','upcoming'], section), place LIMIT 8""",
}

_NAMES = "CASE id " + " ".join(f"WHEN '{r.id}' THEN '{r.name}'" for r in RESET_RULES) + " END"
ORACLE_SQL |= {
    "pulse_places": f"SELECT id, row_number() OVER (ORDER BY moment, id)::INTEGER AS place FROM ({ORACLE_SQL['pulse_stream']})",
    "section_places": ORACLE_SQL["today_places"].replace(" QUALIFY place <= 20", ""),
    "calendar_places": f"""WITH {ITEMS}, {RULES}, marks AS (SELECT id || ':RELEASE' AS id, title, coalesce(start_at, source_published_at) AS moment FROM pub WHERE type IN ('PATCH','UPDATE')
  UNION ALL SELECT id || ':START', title, start_at FROM pub WHERE type IN ('EVENT','BANNER','REWARD','REDEEM_CODE','MAINTENANCE')
  UNION ALL SELECT id || ':END', title, end_at FROM pub WHERE type IN ('EVENT','BANNER','REWARD','REDEEM_CODE','MAINTENANCE')
  UNION ALL SELECT id || ':' || strftime(moment, '%Y-%m-%dT%H:%M:%S.000Z'), {_NAMES}, moment FROM occ WHERE frequency <> 'DAILY')
SELECT id, row_number() OVER (ORDER BY moment, title, id)::INTEGER AS place FROM marks WHERE moment >= TIMESTAMP '2024-01-01' AND moment < TIMESTAMP '2024-02-01'""",
}
