"""The general content query and the smaller selections over items."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import model as M
from ..functions import state as S


@dataclass(frozen=True)
class ContentQuery:
    """``None`` means no restriction, an empty tuple means no rows."""

    game_ids: tuple[str, ...] | None = None
    types: tuple[str, ...] | None = None
    statuses: tuple[str, ...] = ("PUBLISHED",)
    window: tuple[Column, Column] | None = None
    include_synthetic: bool = True
    order: str = "recent"
    limit: int | None = None


def in_window(start: Column, end: Column) -> Column:
    """Closed on both sides: an instant for items at a point in time, an overlap for ranges."""
    at = S.effective()
    overlap = (F.col("end_at").isNull() | (F.col("end_at") >= start)) & (F.col("start_at").isNull() | (F.col("start_at") <= end))
    return F.when(S.point_in_time(), F.coalesce(at.between(start, end), F.lit(False))).otherwise(overlap)


def matches(query: ContentQuery) -> Column:
    """The query's conditions as one conjunction; those on plain columns reach the scan."""
    out = F.lit(True)
    for column, values in (("status", query.statuses), ("game_id", query.game_ids), ("type", query.types)):
        if values is not None:
            out = out & (F.col(column).isin(*values) if values else F.lit(False))
    if not query.include_synthetic:
        out = out & ~F.col("is_synthetic")
    return out & in_window(*query.window) if query.window else out


def ordered(df: DataFrame, order: str = "recent", limit: int | None = None) -> DataFrame:
    eff = S.effective()
    out = df.orderBy(eff.asc_nulls_first() if order == "start" else eff.desc_nulls_last(), "id")
    return out if limit is None else out.limit(limit)


def run(df: DataFrame, query: ContentQuery) -> DataFrame:
    return ordered(df.where(matches(query)), query.order, query.limit)


def for_viewer(items: DataFrame, selected: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Items of the viewer's games (game_id) without what they put away (id)."""
    return items.join(selected, "game_id", "left_semi").join(dismissed, "id", "left_anti")


def latest_released(items: DataFrame, now: Column) -> DataFrame:
    """game_id and id of each game's patch that was released last."""
    w = W.partitionBy("game_id").orderBy(F.desc("start_at"), "number")
    return items.where((F.col("type") == "PATCH") & (F.col("start_at") <= now)).withColumn("n", F.row_number().over(w)).where("n = 1").select("game_id", "id")


def dashboard(items: DataFrame, now: Column) -> DataFrame:
    """What a dashboard keeps: the latest patch of each game, what has not ended long ago, what began lately."""
    latest = latest_released(items, now).select("id").withColumn("latest", F.lit(True))
    recent = F.when(F.col("end_at").isNotNull(), F.col("end_at") >= now - S.span(timedelta(days=35))).otherwise((S.effective() >= now - S.span(timedelta(days=21))) | S.is_type("EVENT", "BANNER"))
    # a row for each game at most: small by the number of games
    return items.join(F.broadcast(latest), "id", "left").where(F.coalesce("latest", F.lit(False)) | F.coalesce(recent, F.lit(False))).drop("latest")


def with_paths(items: DataFrame) -> DataFrame:
    family = M.mapped(F.col("type"), M.ROUTE_FAMILIES)
    return items.withColumn("family", family).withColumn("href", F.concat(F.lit("/"), family, F.lit("/"), F.col("slug")))


def indexable(summary: Column) -> Column:
    return ~F.col("is_synthetic") & ~(S.is_type("ANNOUNCEMENT") & summary.isNull())


def latest_version(raw: DataFrame) -> DataFrame:
    """The row of each (source_id, document_key) that was fetched last."""
    w = W.partitionBy("source_id", "document_key").orderBy(F.desc("fetched_at"), F.desc("content_hash"))
    return raw.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def changes_of_raw(raw: DataFrame) -> DataFrame:
    """Each fetch with ``change``: new, changed or unchanged against the one before."""
    w = W.partitionBy("source_id", "document_key").orderBy("fetched_at", "content_hash")
    before = F.lag("content_hash").over(w)
    return raw.withColumn("change", F.when(before.isNull(), "new").when(before == F.col("content_hash"), "unchanged").otherwise("changed"))
