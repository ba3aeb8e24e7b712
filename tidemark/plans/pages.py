"""What whole pages show, composed of the views; the queries at the end run them over all games at once."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import model as M
from ..functions import recurrence as R
from ..functions import state as S
from ..operators import content as C
from ..operators import diff as D
from ..operators import validate as V
from ..operators.places import numbered
from . import driver_views as D7
from . import views
from .driver_views import now
from .queries import _validated, query
from .store_queries import snapshot_feed

# How far pages look, and how much they show.
DASHBOARD_PAST, DASHBOARD_AHEAD = timedelta(days=45), timedelta(days=60)
PATCHES_MOST, OVERVIEW_PATCHES, OVERVIEW_RECENT, MOMENTS_MOST = 60, 3, 4, 10
OVERVIEW_AHEAD = timedelta(days=30)
#: Changes that one patch out of two snapshots takes.
CHANGES_MOST = 500
PATCH_TYPES = ("PATCH", "UPDATE")


def dashboard(items: DataFrame, now: Column) -> DataFrame:
    """Published content near now, without what a dashboard no longer shows."""
    near = C.ContentQuery(window=(now - S.span(DASHBOARD_PAST), now + S.span(DASHBOARD_AHEAD)))
    return C.dashboard(items.where(C.matches(near)), now)


def latest_patches(items: DataFrame, most: int = PATCHES_MOST) -> DataFrame:
    """The ``most`` latest patches and updates of each game with their place; more are cut before the shuffle."""
    w = W.partitionBy("game_id").orderBy(S.effective().desc(), "id")
    return items.where(S.is_type(*PATCH_TYPES)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def home(items: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """part (highlights, moments), place, id: the first highlights of the digest, and what happens next within two days."""
    first = views.home(views.today(items, rules, now))
    highlights = first.withColumn("place", F.row_number().over(W.orderBy("rank", "place"))).select(F.lit("highlights").alias("part"), "place", "id")  # eight rows
    coming = views.pulse(items, rules, now, past=timedelta(0)).orderBy("at", "id").limit(MOMENTS_MOST)
    moments = coming.withColumn("place", F.row_number().over(W.orderBy("at", "id"))).select(F.lit("moments").alias("part"), "place", "id")  # ten rows
    return highlights.unionByName(moments)


def overview(items: DataFrame, now: Column) -> DataFrame:
    """game_id, part (a timeline, patches), place, id: what each game's page opens with."""
    options = M.TimelineOptions(upcoming=OVERVIEW_AHEAD, recent=OVERVIEW_RECENT)
    groups = views.timeline(items.where(~S.is_type(*PATCH_TYPES)), now, options, by=("game_id",))
    patches = latest_patches(items, OVERVIEW_PATCHES)
    return groups.select("game_id", F.col("timeline").alias("part"), "place", "id").unionByName(patches.select("game_id", F.lit("patches").alias("part"), "place", "id"))


def resets_by_next(rules: DataFrame, now: Column) -> DataFrame:
    """Rules by their next occurrence, with their place."""
    return numbered(R.next_occurrence(rules, now), [], [F.col("next_at"), F.col("id")])


@query
def dashboard_page(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard(D7.items(spark, sf), now()).select("id", "game_id", "type")


@query
def game_patches(spark: SparkSession, sf: str) -> DataFrame:
    """The 60 latest patches and updates of each game: a limit of its page."""
    return latest_patches(D7.published(spark, sf)).select("game_id", "place", "id")


@query
def home_page(spark: SparkSession, sf: str) -> DataFrame:
    """Highlights and coming moments: the few that the page shows."""
    return home(D7.published(spark, sf), R.rules_table(spark), now())


@query
def overview_page(spark: SparkSession, sf: str) -> DataFrame:
    return overview(D7.published(spark, sf), now())


@query
def reset_list(spark: SparkSession, sf: str) -> DataFrame:
    """All rules by their next occurrence."""
    return resets_by_next(D7.reset_rules(spark, sf), now()).select(F.col("id").alias("rule_id"), "place")


@query
def snapshot_patch(spark: SparkSession, sf: str) -> DataFrame:
    """The changes between two snapshots as a patch takes them: the first of each kind of target, and whether there were more."""
    return D.limited(snapshot_feed(spark, sf), ["target_type"], ["target_key", "field"], CHANGES_MOST)


@query
def validation_results(spark: SparkSession, sf: str) -> DataFrame:
    """The results that a run appends for its candidates, without their texts of issues: codes in order."""
    rows = V.results(_validated(spark, sf), "run-1", now())
    return rows.select("candidate_key", "number", "status", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"), "ingestion_run_id", "validator_version")
