"""Paths of values inside candidates that have not the form they should."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import shapes as SH

TYPES = {
    "patch": "struct<version: string, releaseAt: timestamp_ntz, changes: array<struct<targetType: string, targetKey: string, targetName: string, changeType: string, field: string, beforeValue: string, afterValue: string, unit: string, description: string>>>",
    "event": "struct<eventType: string, eligibility: string, rewardSummary: string, rewards: array<struct<name: string, quantity: double, unit: string>>>",
    "reward": "struct<rewardType: string, howToClaim: string, items: array<struct<name: string, quantity: double, unit: string>>, relatedSourceKey: string>",
    "redeemCode": "struct<code: string, region: string, items: array<struct<name: string, quantity: double, unit: string>>>",
    "maintenance": "struct<maintenanceType: string, affectedServers: array<string>, compensationSourceKey: string>",
    "banner": "struct<bannerType: string, phase: double, featured: array<struct<name: string, entityKey: string, rarity: double>>>",
}
GOOD_ITEM = {"name": "gold", "quantity": 5, "unit": None}
GOOD_CHANGE = {"targetType": "ITEM", "targetName": "t", "changeType": "BUFF"}


def paths(spark, kind, **details):
    import json

    row = spark.createDataFrame([(kind, *[json.dumps(details[n]) if n in details else None for n in TYPES])], "kind string, " + ", ".join(f"{n} string" for n in TYPES))
    found = SH.detail_issues(F.col("kind"), {n: F.from_json(n, t) for n, t in TYPES.items()})
    got = row.select(F.explode(found).alias("i")).select("i.*").collect()
    assert all((r.code, r.severity) == ("SCHEMA", "INVALID") for r in got)
    return [r.field for r in got]


@pytest.mark.parametrize(
    ("kind", "details", "want"),
    [
        ("EVENT", {}, ["event"]),
        ("UPDATE", {}, []),
        ("NONE", {}, []),
        ("PATCH", {"patch": {"version": "1", "changes": []}}, []),
        ("PATCH", {"patch": {"version": "", "changes": [GOOD_CHANGE, {**GOOD_CHANGE, "targetType": "X", "unit": "u" * 41}, {"targetName": "t" * 121}]}}, ["patch.version", "patch.changes.1.targetType", "patch.changes.1.unit", "patch.changes.2.targetType", "patch.changes.2.targetName", "patch.changes.2.changeType"]),
        ("PATCH", {"patch": {"version": "1", "changes": [GOOD_CHANGE] * 501}}, ["patch.changes"]),
        ("EVENT", {"event": {"eventType": "LOGIN", "eligibility": "", "rewards": [GOOD_ITEM, {"name": None, "quantity": 0}, {"name": "x", "quantity": -1, "unit": ""}]}}, ["event.eligibility", "event.rewards.1.name", "event.rewards.1.quantity", "event.rewards.2.quantity", "event.rewards.2.unit"]),
        ("REWARD", {"reward": {"rewardType": "LOGIN", "relatedSourceKey": "k" * 301}}, ["reward.items", "reward.relatedSourceKey"]),
        ("REDEEM_CODE", {"redeemCode": {"code": "-abc", "items": [GOOD_ITEM]}}, ["redeemCode.code"]),
        ("REDEEM_CODE", {"redeemCode": {"code": "abc", "items": []}}, ["redeemCode.code"]),
        ("REDEEM_CODE", {"redeemCode": {"code": "Abc-1", "items": []}}, []),
        ("MAINTENANCE", {"maintenance": {"maintenanceType": "X", "affectedServers": ["a", None, ""]}}, ["maintenance.maintenanceType", "maintenance.affectedServers.1", "maintenance.affectedServers.2"]),
        ("BANNER", {"banner": {"bannerType": "WEAPON", "phase": 1.5, "featured": [{"name": "a", "rarity": 6}, {"name": "b", "rarity": 7}, {"name": "c", "rarity": 2.5}]}}, ["banner.phase", "banner.featured.1.rarity", "banner.featured.2.rarity"]),
        ("BANNER", {"banner": {"bannerType": "WEAPON", "phase": 11, "featured": [{"name": "a"}] * 21}}, ["banner.phase", "banner.featured"]),
    ],
)
def test_paths(spark, kind, details, want):
    assert paths(spark, kind, **details) == want
