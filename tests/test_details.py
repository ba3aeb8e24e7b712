"""Details of content read back: defaults, order, links, and localizations."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import details as DT

CONTENT = "id string, type string, source_id string, source_key string, slug string"


def of(spark, rows, name):
    return spark.createDataFrame(rows, f"content_id string, {ALL[name]}")


ALL = {**DT.DETAILS, **DT.CHILDREN}


def test_every_kind_with_and_without_its_detail(spark):
    kinds = ["PATCH", "EVENT", "REWARD", "REDEEM_CODE", "MAINTENANCE", "BANNER", "UPDATE", "ANNOUNCEMENT"]
    rows = [(f"{k}{n}", k, "s", f"key-{k}{n}", f"slug-{k}{n}") for k in kinds for n in (0, 1)]
    tables = {
        "patch": of(spark, [("PATCH1", "1.2", datetime(2024, 1, 2, 3))], "patch"),
        "event": of(spark, [("EVENT1", "LOGIN", None, "much")], "event"),
        "reward": of(spark, [("REWARD1", None, "mail", "key-EVENT1")], "reward"),
        "code": of(spark, [("REDEEM_CODE1", "ABC", None)], "code"),
        "maintenance": of(spark, [("MAINTENANCE1", "EMERGENCY", ["kr"], "key-none")], "maintenance"),
        "banner": of(spark, [("BANNER1", "WEAPON", "2")], "banner"),
        "change": of(spark, [("PATCH1", 2, "a", None, "second", "BUFF", None, "1", "2", None, None), ("PATCH1", 1, "a", None, "first", "NEW", None, None, None, None, None), ("gone", 1, *[None] * 9)], "change"),
        "item": of(spark, [("EVENT1", 1, "gold", 5.0, None), ("REWARD1", 2, "x", None, "u"), ("REWARD1", 1, "y", 1.0, None), ("UPDATE1", 1, "no place for it", None, None)], "item"),
        "featured": of(spark, [("BANNER1", 1, "hero", "h", 5)], "featured"),
    }
    got = {r.id: json.loads(r.d) for r in DT.hydrated(spark.createDataFrame(rows, CONTENT), tables).select("id", F.to_json("detail").alias("d")).collect()}
    assert got["PATCH0"] == {"type": "PATCH", "version": "", "releaseAt": None, "changes": []}
    assert got["PATCH1"]["releaseAt"] == "2024-01-02T03:00:00.000Z" and [c["targetName"] for c in got["PATCH1"]["changes"]] == ["first", "second"]
    assert got["EVENT0"] == {"type": "EVENT", "eventType": "OTHER", "eligibility": None, "rewardSummary": None, "rewards": []}
    assert got["EVENT1"]["rewards"] == [{"name": "gold", "quantity": 5.0, "unit": None}]
    assert got["REWARD0"] == {"type": "REWARD", "rewardType": "OTHER", "howToClaim": None, "items": [], "relatedSlug": None}
    assert (got["REWARD1"]["rewardType"], got["REWARD1"]["relatedSlug"], [i["name"] for i in got["REWARD1"]["items"]]) == ("OTHER", "slug-EVENT1", ["y", "x"])
    assert got["REDEEM_CODE0"] == {"type": "REDEEM_CODE", "code": "", "region": None, "items": []} and got["REDEEM_CODE1"]["code"] == "ABC"
    assert got["MAINTENANCE0"] == {"type": "MAINTENANCE", "maintenanceType": "SCHEDULED", "affectedServers": [], "compensationSlug": None}
    assert got["MAINTENANCE1"] == {"type": "MAINTENANCE", "maintenanceType": "EMERGENCY", "affectedServers": ["kr"], "compensationSlug": None}
    assert got["BANNER0"] == {"type": "BANNER", "bannerType": "OTHER", "phase": None, "featured": []} and got["BANNER1"]["featured"][0]["name"] == "hero"
    assert got["UPDATE1"] == {"type": "UPDATE"} and got["ANNOUNCEMENT0"] == {"type": "ANNOUNCEMENT"}


def test_links_stay_inside_a_source(spark):
    rows = [("1", "REWARD", "s", "a", "one"), ("2", "EVENT", "t", "k", "other"), ("3", "EVENT", "s", "k", "own")]
    tables = {"reward": of(spark, [("1", "X", None, "k")], "reward")}
    got = {r.id: json.loads(r.d) for r in DT.hydrated(spark.createDataFrame(rows, CONTENT), tables).select("id", F.to_json("detail").alias("d")).collect()}
    assert got["1"]["relatedSlug"] == "own" and len(got) == 3
    assert DT.hydrated(spark.createDataFrame([], CONTENT), tables).count() == 0


def test_the_last_localization_holds(spark):
    key = "entity_kind string, entity_id string, locale string, field string, value string, origin string"
    stored = spark.createDataFrame([("e", "1", "ko", "name", "old", "HUMAN"), ("e", "2", "ko", "name", "kept", "HUMAN")], key)
    new = spark.createDataFrame([("e", "1", "ko", "name", "b", "SOURCE", 2), ("e", "1", "ko", "name", "a", "MACHINE", 1), ("e", "1", "en", "name", "c", "SOURCE", 1)], key + ", number int")
    got = {(r.entity_id, r.locale): (r.value, r.origin) for r in DT.localized(stored, new).collect()}
    assert got == {("1", "ko"): ("b", "SOURCE"), ("2", "ko"): ("kept", "HUMAN"), ("1", "en"): ("c", "SOURCE")}
