"""Short forms of content: what a list shows of an item, and texts of pages."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import model as M
from ..functions import state as S
from ..functions.text import single_line
from . import content as C
from .diff import change_line

#: How many changes and reward items a short form names.
CHANGES, REWARDS = 3, 4
DESCRIPTION_MOST = 160
#: Features that fill each tab of a game; a tab without an entry is always there.
TABS = {"overview": (), "calendar": (), "patches": ("patches",), "events": ("events", "banners"), "rewards": ("rewards", "redeemCodes"), "resets": ("resets",)}


def facts(kind: Column, detail: Column) -> Column:
    """struct<version, change_count, changes, label, code, items>: what a kind has to say, from a detail with version, changes
    (array<struct<name, field, before, after>>), label (type of event, reward, maintenance or banner), code, and items (names
    of rewards or of what a banner features)."""
    of = lambda *kinds: kind.isin(*kinds)
    lines = F.transform(F.slice(detail["changes"], 1, CHANGES), lambda c: change_line(c["name"], c["field"], c["before"], c["after"]))
    return F.struct(
        F.when(of("PATCH"), detail["version"]).alias("version"),
        F.when(of("PATCH"), F.size(detail["changes"])).alias("change_count"),
        F.when(of("PATCH"), lines).alias("changes"),
        F.when(of("EVENT", "REWARD", "MAINTENANCE", "BANNER"), detail["label"]).alias("label"),
        F.when(of("REDEEM_CODE"), detail["code"]).alias("code"),
        F.when(of("EVENT", "REWARD", "REDEEM_CODE"), F.slice(detail["items"], 1, REWARDS)).when(of("BANNER"), detail["items"]).alias("items"),
    )


def pulse_items(content: DataFrame) -> DataFrame:
    """The short form of content with slug, summary, precision, verification, source columns and ``detail``."""
    shown = ["id", "slug", "href", "game_id", "type", "title", "summary", "start_at", "end_at", "published_at", "source_published_at", "updated_at", "priority", "verification", "is_synthetic", "source_name", "source_type", "source_url"]
    return C.with_paths(content).select(*shown, F.coalesce("precision", F.lit("DATETIME")).alias("precision"), facts(F.col("type"), F.col("detail")).alias("facts"))


def by_slug(content: DataFrame, slug: str) -> DataFrame:
    return content.where((F.col("slug") == slug) & (F.col("status") == "PUBLISHED"))


def slugs(content: DataFrame, most: int | None = None) -> DataFrame:
    """Addresses of published content: all by slug, or the ``most`` that changed last (a top-k report)."""
    rows = content.where("status = 'PUBLISHED'").select("id", "slug", "type", "game_id", "updated_at")
    return rows.orderBy("slug") if most is None else rows.orderBy(F.desc("updated_at"), "slug").limit(most)


def description(title: Column, summary: Column) -> Column:
    """What a page says of itself to search engines."""
    return F.substring(F.when(F.coalesce(F.trim(summary), F.lit("")) != "", single_line(summary)).otherwise(title), 1, DESCRIPTION_MOST)


def available(features: Column, name: str) -> Column:
    """Whether a game has a feature, in full or limited."""
    return F.coalesce(features[name] != "unsupported", F.lit(False))


def tabs(games: DataFrame) -> DataFrame:
    """Active games (game_id, status, features: map of support) with the tabs that they fill, their features, and the limited
    ones among these."""
    has = lambda names: F.lit(True) if not names else F.exists(F.array(*[available(F.col("features"), n) for n in names]), lambda x: x)
    shown = F.array_compact(F.array(*[F.when(has(names), tab) for tab, names in TABS.items()]))
    kept = F.map_filter("features", lambda _, v: v != "unsupported")
    return games.where("status <> 'INACTIVE'").select("game_id", shown.alias("tabs"), F.array_sort(F.map_keys(kept)).alias("features"), F.array_sort(F.map_keys(F.map_filter(kept, lambda _, v: v == "limited"))).alias("limited"))


def game_tab(kind: Column) -> Column:
    """The tab of a game's pages that shows a kind of content."""
    return M.mapped(kind, {"EVENT": "events", "BANNER": "events", "REWARD": "rewards", "REDEEM_CODE": "rewards", "PATCH": "patches", "UPDATE": "patches"})


def hidden(items: DataFrame, dismissed: DataFrame) -> DataFrame:
    """How many of what was put away (id) is among the items."""
    return items.join(dismissed.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("hidden"))


def game_window(items: DataFrame, game_ids: tuple[str, ...], now: Column, days: int = 120) -> DataFrame:
    """What the pages of games show: published content whose time touches so many days on both sides."""
    span = S.span(timedelta(days=days))
    return items.where(C.matches(C.ContentQuery(game_ids=game_ids, window=(now - span, now + span))))
