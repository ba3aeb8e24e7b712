"""The form of nested values: what a candidate's details have to look like, and a path to each value that does not.

A form is data, a tree of texts, numbers, choices, lists and fields; ``issues`` turns it into one expression of built-in
functions. Lists are checked element by element inside the row, at any depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


ISSUE = "array<struct<code: string, severity: string, field: string>>"


@dataclass(frozen=True)
class Text:
    high: int
    nullable: bool = False
    low: int = 1
    pattern: str | None = None

    def bad(self, value: Column) -> Column:
        wrong = ~F.length(value).between(self.low, self.high)
        return wrong if self.pattern is None else wrong | ~value.rlike(self.pattern)


@dataclass(frozen=True)
class Number:
    """``above``: has to be more than that; ``high``: no more than that."""

    above: float
    high: float | None = None
    whole: bool = False
    nullable: bool = True

    def bad(self, value: Column) -> Column:
        x = value.cast("double")
        wrong = ~(x > self.above) | F.isnan(x) | (F.abs(x) == float("inf"))
        if self.high is not None:
            wrong = wrong | (x > self.high)
        return wrong | (x != F.floor(x)) if self.whole else wrong


@dataclass(frozen=True)
class OneOf:
    values: tuple[str, ...]
    nullable: bool = False

    def bad(self, value: Column) -> Column:
        return ~value.isin(*self.values)


@dataclass(frozen=True)
class Any:
    nullable: bool = True

    def bad(self, value: Column) -> Column:
        return F.lit(False)


@dataclass(frozen=True)
class Many:
    of: object
    most: int
    nullable: bool = False


@dataclass(frozen=True)
class Fields:
    fields: dict[str, object]
    nullable: bool = False


# The choices and bounds that decide results.
EVENT_TYPES = ("IN_GAME", "WEB", "LOGIN", "LIMITED_MODE", "COLLAB", "SEASONAL", "OTHER")
REWARD_TYPES = ("EVENT", "ATTENDANCE", "LOGIN", "COMPENSATION", "REDEEM_CODE", "WEB_EVENT", "OTHER")
MAINTENANCE_TYPES = ("SCHEDULED", "EMERGENCY", "EXTENDED")
BANNER_TYPES = ("CHARACTER", "WEAPON", "STANDARD", "CHRONICLED", "COLLAB", "OTHER")
CHANGE_TYPES = ("BUFF", "NERF", "ADJUST", "NEW", "REMOVED", "REWORK", "FIX", "SYSTEM")
ENTITY_TYPES = ("CHAMPION", "ITEM", "RUNE", "CHARACTER", "WEAPON", "CLASS", "BOSS", "MODE", "SYSTEM", "OTHER")
CODE = "^[A-Za-z0-9][A-Za-z0-9-]{3,39}$"
_CHANGE = Fields({
    "targetType": OneOf(ENTITY_TYPES), "targetKey": Text(80, True), "targetName": Text(120), "changeType": OneOf(CHANGE_TYPES), "field": Text(160, True),
    "beforeValue": Text(160, True), "afterValue": Text(160, True), "unit": Text(40, True), "description": Text(500, True),
})
_ITEMS = Many(Fields({"name": Text(120), "quantity": Number(0), "unit": Text(40, True)}), 50)
_FEATURED = Fields({"name": Text(120), "entityKey": Text(80, True), "rarity": Number(0, 6, True)})
#: The name and the form of the details of each kind that has some.
DETAILS = {
    "PATCH": ("patch", Fields({"version": Text(40), "releaseAt": Any(), "changes": Many(_CHANGE, 500)})),
    "EVENT": ("event", Fields({"eventType": OneOf(EVENT_TYPES), "eligibility": Text(300, True), "rewardSummary": Text(300, True), "rewards": _ITEMS})),
    "REWARD": ("reward", Fields({"rewardType": OneOf(REWARD_TYPES), "howToClaim": Text(300, True), "items": _ITEMS, "relatedSourceKey": Text(300, True)})),
    "REDEEM_CODE": ("redeemCode", Fields({"code": Text(40, pattern=CODE), "region": Text(32, True), "items": _ITEMS})),
    "MAINTENANCE": ("maintenance", Fields({"maintenanceType": OneOf(MAINTENANCE_TYPES), "affectedServers": Many(Text(60), 50), "compensationSourceKey": Text(300, True)})),
    "BANNER": ("banner", Fields({"bannerType": OneOf(BANNER_TYPES), "phase": Number(0, 10, True), "featured": Many(_FEATURED, 20)})),
}


def _one(path: Column) -> Column:
    return F.array(F.struct(F.lit("SCHEMA").alias("code"), F.lit("INVALID").alias("severity"), path.alias("field"))).cast(ISSUE)


def issues(value: Column, form: object, path: Column) -> Column:
    """Issues of a value, one for each path that is not as its form says; what is missing has no issues below it."""
    none = F.array().cast(ISSUE)
    if isinstance(form, Fields):
        below = F.concat(*[issues(value[n], f, F.concat(path, F.lit(f".{n}"))) for n, f in form.fields.items()])
    elif isinstance(form, Many):
        each = F.flatten(F.transform(value, lambda x, i: issues(x, form.of, F.concat(path, F.lit("."), i.cast("string")))))
        below = F.concat(F.when(F.size(value) > form.most, _one(path)).otherwise(none), each)
    else:
        below = F.when(F.coalesce(form.bad(value), F.lit(False)), _one(path)).otherwise(none)
    return F.when(value.isNull(), none if form.nullable else _one(path)).otherwise(below)


def detail_issues(kind: Column, details: dict[str, Column]) -> Column:
    """Issues of the details of a candidate, by its kind. ``details``: a column for each name in DETAILS; kinds without
    details, and unknown ones, have no issues here."""
    out = F.array().cast(ISSUE)
    for of, (name, form) in DETAILS.items():
        out = F.when(kind == of, issues(details[name], form, F.lit(name))).otherwise(out)
    return out
