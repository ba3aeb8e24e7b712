"""Joins between content, its sources and its children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import deterministic_uuid


def related(content: DataFrame) -> DataFrame:
    """id and related_id: the published record of the same source that ``related_source_key`` names, else null."""
    target = content.where("status = 'PUBLISHED'").groupBy("source_id", F.col("source_key").alias("related_source_key")).agg(F.min("id").alias("related_id"))
    return content.select("id", "source_id", "related_source_key").join(target, ["source_id", "related_source_key"], "left").select("id", "related_id")


def with_children(content: DataFrame, children: DataFrame, name: str, order: str = "position") -> DataFrame:
    """Content with its children (content_id, position, ...) as an ordered array; none is an empty one."""
    fields = [c for c in children.columns if c != "content_id"]
    rest = F.struct(order, *[c for c in fields if c != order])
    lists = children.groupBy(F.col("content_id").alias("id")).agg(F.sort_array(F.collect_list(rest)).alias(name))
    joined = content.join(lists, "id", "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def with_entities(names: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``names`` (type, key, name) with ``entity_id``, and the entities that are new: (type, key) once each, the name that
    sorts last holds."""
    wanted = names.groupBy("type", "key").agg(F.max("name").alias("name"))
    new = wanted.join(entities.select("type", "key"), ["type", "key"], "left_anti").withColumn("entity_id", deterministic_uuid(F.concat_ws(":", F.lit("entity"), "type", "key")))
    every = entities.select("type", "key", "entity_id").unionByName(new.select("type", "key", "entity_id"))
    return names.join(every, ["type", "key"], "left"), new
