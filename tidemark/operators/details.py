"""Content with its details: six kinds of details and three kinds of children, read back as one tagged value.

Rows of all detail and child tables meet in one union, one column for each table, and are gathered by one aggregation: the
detail of a record and its children come out of the same shuffle, whatever kind it is. The value is a VARIANT: each kind has
fields of its own. What is missing has a default, so every record of a kind has the same fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables of details and of children: name and fields.
DETAILS = {
    "patch": "version string, release_at timestamp_ntz",
    "event": "event_type string, eligibility string, reward_summary string",
    "reward": "reward_type string, how_to_claim string, related_source_key string",
    "code": "code string, region string",
    "maintenance": "maintenance_type string, affected_servers array<string>, compensation_source_key string",
    "banner": "banner_type string, phase string",
}
CHILDREN = {
    "change": "position int, target_type string, target_key string, target_name string, change_type string, field string, before_value string, after_value string, unit string, description string",
    "item": "position int, name string, quantity double, unit string",
    "featured": "position int, name string, entity_key string, rarity int",
}


def _kind(fields: str) -> str:
    return "struct<" + ", ".join(": ".join(f.split(None, 1)) for f in fields.split(", ")) + ">"


def gathered(tables: dict[str, DataFrame]) -> DataFrame:
    """content_id, a struct for each kind of detail (null if there is none) and an array for each kind of children, in the
    order of their positions. ``tables``: any of DETAILS and CHILDREN by name, with content_id. Of several details of one
    record and kind the greatest holds."""
    parts = []
    for name, fields in {**DETAILS, **CHILDREN}.items():
        if name in tables:
            parts.append(tables[name].select("content_id", F.struct(*[F.col(f.split()[0]) for f in fields.split(", ")]).cast(_kind(fields)).alias(name)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name, fields in {**DETAILS, **CHILDREN}.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(_kind(fields)))
    return rows.groupBy("content_id").agg(*[F.max(n).alias(n) for n in DETAILS], *[F.sort_array(F.collect_list(n)).alias(f"{n}s") for n in CHILDREN])


def linked_slugs(content: DataFrame, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """id and ``name``: the slug of the record of the same source that ``wanted`` (content_id, ``key``) names, else null."""
    asked = wanted.where(F.col(key).isNotNull()).select(F.col("content_id").alias("id"), F.col(key).alias("_key")).join(content.select("id", "source_id"), "id")
    target = content.groupBy("source_id", F.col("source_key").alias("_key")).agg(F.min_by("slug", "id").alias(name))
    return asked.join(target, ["source_id", "_key"]).groupBy("id").agg(F.min(name).alias(name))


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _without_position(children: str) -> Column:
    fields = CHILDREN[children.removesuffix("s")].split(", ")[1:]
    names = [f.split()[0] for f in fields]
    shown = lambda n: n.split("_")[0] + "".join(x.title() for x in n.split("_")[1:])
    empty = F.array().cast(f"array<{_kind(', '.join(f'{shown(f.split()[0])} {f.split()[1]}' for f in fields))}>")
    return F.coalesce(F.transform(children, lambda c: F.struct(*[c[n].alias(shown(n)) for n in names])), empty)


def detail(kind: Column) -> Column:
    """The tagged value of a row of content beside what ``gathered`` and the links give; an unknown kind has its tag alone."""
    of = lambda name, field, default=None: F.coalesce(F.col(f"{name}.{field}"), F.lit(default)) if default is not None else F.col(f"{name}.{field}")
    value = lambda *fields: F.to_variant_object(F.struct(kind.alias("type"), *fields))
    rewards, servers = _without_position("items"), F.coalesce("maintenance.affected_servers", F.array().cast("array<string>"))
    return (
        F.when(kind == "PATCH", value(of("patch", "version", "").alias("version"), _iso(F.col("patch.release_at")).alias("releaseAt"), _without_position("changes").alias("changes")))
        .when(kind == "EVENT", value(of("event", "event_type", "OTHER").alias("eventType"), of("event", "eligibility").alias("eligibility"), of("event", "reward_summary").alias("rewardSummary"), rewards.alias("rewards")))
        .when(kind == "REWARD", value(of("reward", "reward_type", "OTHER").alias("rewardType"), of("reward", "how_to_claim").alias("howToClaim"), rewards.alias("items"), F.col("related_slug").alias("relatedSlug")))
        .when(kind == "REDEEM_CODE", value(of("code", "code", "").alias("code"), of("code", "region").alias("region"), rewards.alias("items")))
        .when(kind == "MAINTENANCE", value(of("maintenance", "maintenance_type", "SCHEDULED").alias("maintenanceType"), servers.alias("affectedServers"), F.col("compensation_slug").alias("compensationSlug")))
        .when(kind == "BANNER", value(of("banner", "banner_type", "OTHER").alias("bannerType"), of("banner", "phase").alias("phase"), _without_position("featureds").alias("featured")))
        .otherwise(value())
    )


def hydrated(content: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``content`` (id, type, source_id, source_key, slug, ...) with ``detail``, a VARIANT. Rows of ``tables`` without a
    record are left out."""
    rows = content.join(gathered(tables).withColumnRenamed("content_id", "id"), "id", "left")
    for table, key, name in (("reward", "related_source_key", "related_slug"), ("maintenance", "compensation_source_key", "compensation_slug")):
        links = linked_slugs(content, tables[table], key, name) if table in tables else None
        rows = rows.withColumn(name, F.lit(None).cast("string")) if links is None else rows.join(links, "id", "left")
    return rows.select(*content.columns, detail(F.col("type")).alias("detail"))


def localized(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Localizations (entity_kind, entity_id, locale, field, value, origin) after those of a batch, which have ``number`` too:
    the last one of a key holds, and the batch's before the stored one."""
    key = ["entity_kind", "entity_id", "locale", "field"]
    last = new.groupBy(*key).agg(F.max_by(F.struct("value", "origin"), F.struct("number", "value")).alias("n"))
    both = stored.join(last, key, "full_outer")
    return both.select(*key, F.coalesce("n.value", "value").alias("value"), F.coalesce("n.origin", "origin").alias("origin"))
