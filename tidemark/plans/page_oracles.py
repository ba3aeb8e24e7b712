"""The queries of ``pages.py`` as DuckDB SQL."""

from . import store_oracles  # noqa: F401  it adds to the table below
from .oracles import ALL_RULES, CHECKED, ITEMS, NEXT, NOW, ORACLE_SQL

_NEAR = f"""CASE WHEN type IN ('PATCH','UPDATE','ANNOUNCEMENT') OR (start_at IS NULL AND end_at IS NULL) THEN eff BETWEEN {NOW} - INTERVAL 45 DAY AND {NOW} + INTERVAL 60 DAY
  ELSE coalesce(end_at >= {NOW} - INTERVAL 45 DAY, true) AND coalesce(start_at <= {NOW} + INTERVAL 60 DAY, true) END"""
ORACLE_SQL |= {
    "dashboard_page": f"""WITH {ITEMS}, near AS (SELECT * FROM pub WHERE {_NEAR}), latest AS (SELECT id FROM near WHERE type = 'PATCH' AND start_at <= {NOW} QUALIFY row_number() OVER (PARTITION BY game_id ORDER BY start_at DESC, number) = 1)
SELECT id, game_id, type FROM near WHERE id IN (SELECT id FROM latest) OR CASE WHEN end_at IS NOT NULL THEN end_at >= {NOW} - INTERVAL 35 DAY ELSE eff >= {NOW} - INTERVAL 21 DAY OR type IN ('EVENT','BANNER') END""",
    "game_patches": f"WITH {ITEMS} SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY eff DESC, id)::INTEGER AS place, id FROM pub WHERE type IN ('PATCH','UPDATE') QUALIFY place <= 60",
    "home_page": f"""SELECT 'highlights' AS part, row_number() OVER (ORDER BY list_position(['critical','rewards','resets','endingSoon','newEvents','maintenance','upcoming'], section), place)::INTEGER AS place, id FROM ({ORACLE_SQL["home_highlights"]})
UNION ALL SELECT 'moments', row_number() OVER (ORDER BY moment, id)::INTEGER AS n, id FROM ({ORACLE_SQL["pulse_stream"]}) WHERE moment >= {NOW} QUALIFY n <= 10""",
    "overview_page": f"""SELECT game_id, timeline AS part, place, id FROM ({ORACLE_SQL["timeline_groups"].replace("FROM pub)", "FROM pub WHERE type NOT IN ('PATCH','UPDATE'))", 1).replace("INTERVAL 60 DAY", "INTERVAL 30 DAY").replace("place <= 10", "place <= 4")})
UNION ALL (WITH {ITEMS} SELECT game_id, 'patches', row_number() OVER (PARTITION BY game_id ORDER BY eff DESC, id)::INTEGER AS n, id FROM pub WHERE type IN ('PATCH','UPDATE') QUALIFY n <= 3)""",
    "reset_list": f"WITH {ALL_RULES}, {NEXT} SELECT id AS rule_id, row_number() OVER (ORDER BY next_at, id)::INTEGER AS place FROM nexts",
    "snapshot_patch": f"""WITH c AS ({ORACLE_SQL["snapshot_feed"]}) SELECT *, count(*) OVER (PARTITION BY target_type) > 500 AS truncated FROM c QUALIFY row_number() OVER (PARTITION BY target_type ORDER BY target_key, field) <= 500""",
    "validation_results": f"""WITH {CHECKED} SELECT source_key AS candidate_key, number, ['VALID','WARNING','REVIEW','INVALID'][level + 1] AS status, array_to_string(list_transform(issues, lambda i: i.code), ',') AS codes, 'run-1' AS ingestion_run_id, '3' AS validator_version FROM decided""",
}
