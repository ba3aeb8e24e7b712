"""Time-dependent classifications as columns. ``now`` is a parameter everywhere: results depend on it and on nothing else.

Columns expected: type, start_at, end_at, source_published_at, published_at, priority. All instants are of one timestamp
type (with or without zone). A null instant means unknown.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import model as M


def instant(value: datetime | str | Column) -> Column:
    """A literal without time zone, or the column itself."""
    if isinstance(value, Column):
        return value
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def span(value: timedelta) -> Column:
    return F.lit(value)


def is_type(*types: str) -> Column:
    return F.col("type").isin(*types)


def effective(default: Column | None = None) -> Column:
    """When an item takes effect: start, else publication at the source, else publication here."""
    return F.coalesce("start_at", "source_published_at", "published_at", *([default] if default is not None else []))


def point_in_time() -> Column:
    return is_type(*M.POINT_IN_TIME_TYPES) | (F.col("start_at").isNull() & F.col("end_at").isNull())


def time_status(now: Column, start: str = "start_at", end: str = "end_at", ending_soon: Column | timedelta = M.ENDING_SOON) -> Column:
    s, e = F.col(start), F.col(end)
    limit = ending_soon if isinstance(ending_soon, Column) else span(ending_soon)
    return (
        F.when(s.isNull() & e.isNull(), "UNKNOWN")
        .when(now < s, "UPCOMING")
        .when(now >= e, "ENDED")
        .when((limit > span(timedelta(0))) & (e - now <= limit), "ENDING_SOON")
        .otherwise("LIVE")
    )


def type_status(now: Column) -> Column:
    """Status with the threshold of the item's type: maintenance is never about to end."""
    return time_status(now, ending_soon=F.when(is_type("MAINTENANCE"), span(timedelta(0))).otherwise(span(M.ENDING_SOON)))


def reward_state(status: Column) -> Column:
    return F.when(status == "LIVE", "AVAILABLE").when(status == "ENDED", "EXPIRED").otherwise(status)


def claimable(state: Column) -> Column:
    return state.isin("AVAILABLE", "ENDING_SOON")


def active(status: Column) -> Column:
    return status.isin("LIVE", "ENDING_SOON")


def maintenance_state(now: Column) -> Column:
    status = time_status(now, ending_soon=timedelta(0))
    forgotten = F.col("end_at").isNull() & F.col("start_at").isNotNull() & (now - F.col("start_at") > span(M.OPEN_MAINTENANCE_MOST))
    return F.when(status == "UPCOMING", "SCHEDULED").when(status == "ENDED", "COMPLETED").when(status == "UNKNOWN", "UNKNOWN").when(forgotten, "UNKNOWN").otherwise("IN_PROGRESS")


def with_states(items: DataFrame, now: Column) -> DataFrame:
    """Items with ``time_status`` and ``upkeep`` (state of maintenance), which the classifiers below read. As columns of
    their own they are computed once a row, however often a classifier names them."""
    return items.withColumns({"time_status": type_status(now), "upkeep": maintenance_state(now)})


def urgency(now: Column) -> Column:
    """struct<tier, reason, at>: how soon an item asks for attention, 1 first. Reads the columns of ``with_states``."""

    def is_(tier: int, reason: str, at: Column | None) -> Column:
        none = F.lit(None).cast("timestamp_ntz")
        return F.struct(F.lit(tier).alias("tier"), F.lit(reason).alias("reason"), (none if at is None else at.cast("timestamp_ntz")).alias("at"))

    start, end, eff = F.col("start_at"), F.col("end_at"), effective()
    kept, status = F.col("upkeep"), F.col("time_status")
    going = status.isin("LIVE", "ENDING_SOON", "UNKNOWN")
    maintenance = F.when(kept == "IN_PROGRESS", is_(1, "MAINTENANCE_LIVE", end)).when(kept == "SCHEDULED", is_(8, "UPCOMING", start)).otherwise(is_(10, "NONE", None))
    fresh = (eff <= now) & (now - eff <= span(M.NEW_CONTENT))
    return (
        F.when(is_type("MAINTENANCE"), maintenance)
        .when(status == "ENDED", is_(10, "NONE", end))
        .when(going & (end - now <= span(6 * M.HOUR)), is_(2, "EXPIRES_6H", end))
        .when(is_type("REWARD", "REDEEM_CODE") & active(status), is_(3, "CLAIMABLE_REWARD", end))
        .when(going & (end - now <= span(24 * M.HOUR)), is_(4, "EXPIRES_24H", end))
        .when(is_type("PATCH", "UPDATE") & fresh, is_(6, "NEW_PATCH", eff))
        .when(is_type("EVENT", "BANNER") & (status == "LIVE") & (now - start <= span(M.NEW_CONTENT)), is_(7, "NEW_EVENT", start))
        .when(status == "UPCOMING", is_(8, "UPCOMING", start))
        .when(going, is_(9, "ONGOING", end))
        .otherwise(is_(10, "NONE", None))
    )


def reset_urgency(next_at: Column, now: Column) -> Column:
    soon = next_at - now <= span(24 * M.HOUR)
    return F.struct(F.when(soon, 5).otherwise(8).alias("tier"), F.when(soon, "RESET_24H").otherwise("UPCOMING").alias("reason"), next_at.alias("at"))


def today_section(now: Column, options: M.TodayOptions = M.TodayOptions()) -> Column:
    """The section of a daily digest that an item belongs to, or null. An item has one section at most."""
    start, eff, status = F.col("start_at"), effective(), F.col("time_status")
    kept, age = F.col("upkeep"), now - effective()

    def starts_within(w: timedelta) -> Column:
        return (start > now) & (start - now <= span(w))

    timeless = start.isNull() & F.col("end_at").isNull()
    return (
        F.when(
            is_type("MAINTENANCE"),
            F.when(kept == "IN_PROGRESS", "critical")
            .when((kept == "SCHEDULED") & starts_within(options.upcoming), "maintenance")
            .when((kept == "UNKNOWN") & timeless & (age <= span(options.notice_age)), "maintenance"),
        )
        .when(
            is_type("PATCH", "UPDATE"),
            F.when((eff <= now) & (age <= span(M.NEW_CONTENT)), "critical").when(starts_within(options.patch_critical), "critical").when(starts_within(options.upcoming), "upcoming"),
        )
        .when(
            is_type("REWARD", "REDEEM_CODE"),
            F.when(active(status), "rewards").when((status == "UNKNOWN") & (age <= span(options.upcoming)), "rewards").when((status == "UPCOMING") & starts_within(options.upcoming), "upcoming"),
        )
        .when(
            is_type("EVENT", "BANNER"),
            F.when(status == "ENDING_SOON", "endingSoon")
            .when((status == "LIVE") & (now - start <= span(M.NEW_CONTENT)), "newEvents")
            .when((status == "UPCOMING") & starts_within(options.upcoming), "upcoming"),
        )
        .when(is_type("ANNOUNCEMENT"), F.when((age <= span(options.notice_age)) & (F.col("priority") >= options.notice_priority), "critical"))
    )


def timeline_group(now: Column) -> Column:
    """current, upcoming, recent or null."""
    kept, status, eff = F.col("upkeep"), F.col("time_status"), effective()
    return (
        F.when(
            is_type("MAINTENANCE"),
            F.when(kept == "IN_PROGRESS", "current").when(kept == "SCHEDULED", "upcoming").when(kept == "COMPLETED", "recent").when(F.col("start_at") <= now, "recent"),
        )
        .when(point_in_time(), F.when(eff > now, "upcoming").otherwise("recent"))
        .when(active(status), "current")
        .when(status == "UPCOMING", "upcoming")
        .when(status == "ENDED", "recent")
    )


def closed_at() -> Column:
    return F.coalesce(F.col("end_at"), effective())


def publication(validation: Column, source_type: Column, parser: Column) -> Column:
    """struct<status, verification>; null for what is not stored."""

    def is_(status: str, verification: Column | str) -> Column:
        return F.struct(F.lit(status).alias("status"), (verification if isinstance(verification, Column) else F.lit(verification)).alias("verification"))

    manual = F.when(parser == "ai", "UNVERIFIED").otherwise("MANUAL_VERIFIED")
    return (
        F.when(validation == "INVALID", None)
        .when(validation == "REVIEW", is_("PENDING_REVIEW", "UNVERIFIED"))
        .when(source_type == "MANUAL", is_("PUBLISHED", manual))
        .when(source_type.isin(*M.OFFICIAL_SOURCE_TYPES) & parser.isin("deterministic", "ai"), is_("PUBLISHED", "AUTO_VERIFIED"))
        .otherwise(is_("PUBLISHED", "UNVERIFIED"))
    )


def worst_status(a: Column, b: Column) -> Column:
    return F.when(M.severity(b) > M.severity(a), b).otherwise(a)


#: The tone of each label of a badge.
TONES = {
    "UPCOMING": "upcoming", "SCHEDULED": "upcoming", "RELEASING": "upcoming", "LIVE": "live", "AVAILABLE": "live", "IN_PROGRESS": "urgent", "ENDING_SOON": "soon", "CLAIM_SOON": "soon",
    "NEW": "info", "ENDED": "ended", "EXPIRED": "ended", "COMPLETED": "ended", "RELEASED": "neutral", "UNKNOWN": "neutral",
}


def presentation(now: Column) -> Column:
    """struct<tone, label> of an item's badge; null where it has none: announcements, releases without a date, and events
    and banners of unknown time."""
    status, release = F.col("time_status"), F.coalesce("start_at", "source_published_at")
    label = (
        F.when(is_type("MAINTENANCE"), F.col("upkeep"))
        .when(is_type("REWARD", "REDEEM_CODE"), F.when(status == "ENDING_SOON", "CLAIM_SOON").otherwise(reward_state(status)))
        .when(is_type("PATCH", "UPDATE"), F.when(release > now, "RELEASING").when(now - release <= span(M.NEW_CONTENT), "NEW").when(release.isNotNull(), "RELEASED"))
        .when(is_type("EVENT", "BANNER") & (status != "UNKNOWN"), status)
    )
    return F.when(label.isNotNull(), F.struct(M.mapped(label, TONES).alias("tone"), label.alias("label")))


def focus() -> Column:
    """struct<kind, at>: the instant of an item that matters next."""
    status = F.col("time_status")
    ends = F.struct(F.when(is_type("REWARD", "REDEEM_CODE"), "claim-by").otherwise("ends").alias("kind"), F.col("end_at").alias("at"))
    starts = F.struct(F.lit("starts").alias("kind"), F.col("start_at").alias("at"))
    return F.when(status == "UPCOMING", starts).when(active(status) & F.col("end_at").isNotNull(), ends)
