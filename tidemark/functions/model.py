"""Enumerations, ranks and limits of the content model."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide results and have to read like this.
CONTENT_TYPES = ("PATCH", "UPDATE", "EVENT", "REWARD", "REDEEM_CODE", "MAINTENANCE", "BANNER", "ANNOUNCEMENT")
POINT_IN_TIME_TYPES = ("PATCH", "UPDATE", "ANNOUNCEMENT")
RANGE_TYPES = ("EVENT", "BANNER", "REWARD", "REDEEM_CODE", "MAINTENANCE")
SOURCE_TYPES = ("OFFICIAL_API", "OFFICIAL_FEED", "OFFICIAL_WEB", "MANUAL", "TRUSTED_FALLBACK", "FIXTURE")
OFFICIAL_SOURCE_TYPES = SOURCE_TYPES[:3]
VALIDATION_STATUSES = ("VALID", "WARNING", "REVIEW", "INVALID")
GAMES = ("lol", "lostark", "maplestory", "genshin", "wuwa")
TODAY_SECTIONS = ("critical", "rewards", "resets", "endingSoon", "newEvents", "maintenance", "upcoming")
ROUTE_FAMILIES = {
    "PATCH": "patches",
    "UPDATE": "patches",
    "EVENT": "events",
    "BANNER": "events",
    "REWARD": "rewards",
    "REDEEM_CODE": "rewards",
    "MAINTENANCE": "notices",
    "ANNOUNCEMENT": "notices",
}
#: Lower is stronger.
AUTHORITY = {name: i + 1 for i, name in enumerate(SOURCE_TYPES)}
SEVERITY = {name: i for i, name in enumerate(VALIDATION_STATUSES)}

HOUR, DAY = timedelta(hours=1), timedelta(days=1)
ENDING_SOON = 48 * HOUR
OPEN_MAINTENANCE_MOST = 12 * HOUR
NEW_CONTENT = 3 * DAY
MAINTENANCE_AHEAD = 3 * DAY
RANGE_MOST, START_MOST, QUANTITY_MOST = 366 * DAY, 732 * DAY, 10_000_000
SYNTHETIC_CODE_PREFIX = "GPTEST-"


@dataclass(frozen=True)
class TodayOptions:
    upcoming: timedelta = 7 * DAY
    resets: timedelta = 7 * DAY
    patch_critical: timedelta = 24 * HOUR
    notice_priority: int = 80
    notice_age: timedelta = 48 * HOUR
    dismissed: tuple[str, ...] = ()


@dataclass(frozen=True)
class TimelineOptions:
    upcoming: timedelta = 60 * DAY
    past: timedelta = 30 * DAY
    recent: int = 10


def mapped(column: Column, table: dict) -> Column:
    """The value that a small fixed table has for a column, null if none."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[column]


def authority(source_type: Column) -> Column:
    return mapped(source_type, AUTHORITY)


def severity(status: Column) -> Column:
    return mapped(status, SEVERITY)


def ranked(column: Column, names: tuple[str, ...]) -> Column:
    """Place of a value in a tuple, from 0."""
    return mapped(column, {n: i for i, n in enumerate(names)})
