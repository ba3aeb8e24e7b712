"""Recurring schedules. Rules are a small dimension: their text is parsed on the driver into typed columns, and instants
are made by date sequences joined with it, in local time, then converted (a gap moves forward, an overlap takes the earlier).

What differs from RFC 5545 on purpose: BYMONTHDAY and BYDAY of a monthly rule unite; a date-only UNTIL ends with that day in
UTC; a weekly rule without BYDAY takes the anchor's weekday; days are searched up to a horizon, beyond it there is nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import times as T

WEEKDAY_CODES = {"MO": 1, "TU": 2, "WE": 3, "TH": 4, "FR": 5, "SA": 6, "SU": 7}


class RuleError(ValueError):
    """A recurrence text that is not understood."""


@dataclass(frozen=True)
class Parsed:
    freq: str
    interval: int = 1
    by_day: tuple[tuple[int, int | None], ...] = ()
    by_month_day: tuple[int, ...] = ()
    by_hour: tuple[int, ...] = ()
    by_minute: tuple[int, ...] = ()
    until: datetime | None = None


@dataclass(frozen=True)
class Rule:
    id: str
    game_id: str
    name: str
    frequency: str
    timezone: str
    hour: int
    minute: int
    day_of_week: int | None = None
    day_of_month: int | None = None
    rrule: str | None = None
    anchor: datetime | None = None
    region: str | None = None
    is_primary: bool = False
    is_active: bool = True
    source_url: str | None = field(default=None, compare=False)


def _numbers(text: str, low: int, high: int, signed: bool = False) -> tuple[int, ...]:
    out = []
    for part in text.split(","):
        if not re.fullmatch(r"[+-]?\d{1,3}" if signed else r"\d{1,3}", part):
            raise RuleError(f"not a number: {part!r}")
        n = int(part)
        if not low <= abs(n) <= high or (n == 0 and low > 0):
            raise RuleError(f"out of range: {n}")
        out.append(n)
    return tuple(out)


def _until(text: str) -> datetime:
    m = re.fullmatch(r"(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})Z)?", text)
    if not m:
        raise RuleError(f"bad UNTIL: {text!r}")
    clock = (int(x) for x in m.groups()[3:]) if m[4] else (23, 59, 59)
    try:
        return datetime(int(m[1]), int(m[2]), int(m[3]), *clock)
    except ValueError as e:
        raise RuleError(f"bad UNTIL: {text!r}") from e


def parse_rrule(text: str) -> Parsed:
    """The supported part of a recurrence text; anything else raises RuleError."""
    parts: dict[str, str] = {}
    for item in re.sub(r"^RRULE:", "", text.strip()).upper().split(";"):
        name, eq, value = item.partition("=")
        if not eq or not value or name in parts:
            raise RuleError(f"bad or repeated part: {item!r}")
        parts[name] = value
    unknown = parts.keys() - {"FREQ", "INTERVAL", "BYDAY", "BYMONTHDAY", "BYHOUR", "BYMINUTE", "UNTIL", "WKST"}
    freq = parts.get("FREQ")
    if unknown or freq not in ("DAILY", "WEEKLY", "MONTHLY"):
        raise RuleError(f"not supported: {text!r}")
    if parts.get("WKST", "MO") != "MO":
        raise RuleError("weeks start on Monday")
    interval = _numbers(parts["INTERVAL"], 1, 366)[0] if "INTERVAL" in parts else 1
    days = []
    for code in parts["BYDAY"].split(",") if "BYDAY" in parts else ():
        m = re.fullmatch(r"([+-]?[1-5])?(MO|TU|WE|TH|FR|SA|SU)", code)
        if not m or (m[1] and freq != "MONTHLY") or freq == "DAILY":
            raise RuleError(f"bad BYDAY: {code!r}")
        days.append((WEEKDAY_CODES[m[2]], int(m[1]) if m[1] else None))
    if "BYMONTHDAY" in parts and freq != "MONTHLY":
        raise RuleError("BYMONTHDAY needs FREQ=MONTHLY")
    return Parsed(
        freq,
        interval,
        tuple(days),
        _numbers(parts["BYMONTHDAY"], 1, 31, signed=True) if "BYMONTHDAY" in parts else (),
        _numbers(parts["BYHOUR"], 0, 23) if "BYHOUR" in parts else (),
        _numbers(parts["BYMINUTE"], 0, 59) if "BYMINUTE" in parts else (),
        _until(parts["UNTIL"]) if "UNTIL" in parts else None,
    )


# The published resets of the registered games.
RESET_RULES = (
    Rule("lostark-daily", "lostark", "일일 초기화", "DAILY", "Asia/Seoul", 6, 0, region="kr"),
    Rule("lostark-weekly", "lostark", "주간 초기화", "WEEKLY", "Asia/Seoul", 6, 0, day_of_week=3, region="kr", is_primary=True),
    Rule("maplestory-daily", "maplestory", "일일 초기화", "DAILY", "Asia/Seoul", 0, 0, region="kr"),
    Rule("maplestory-weekly", "maplestory", "주간 보스·콘텐츠 초기화", "WEEKLY", "Asia/Seoul", 0, 0, day_of_week=4, region="kr", is_primary=True),
    Rule("maplestory-monthly", "maplestory", "월간 보스 초기화", "MONTHLY", "Asia/Seoul", 0, 0, day_of_month=1, region="kr"),
    Rule("genshin-daily", "genshin", "일일 초기화", "DAILY", "UTC+8", 4, 0, region="asia"),
    Rule("genshin-weekly", "genshin", "주간 초기화", "WEEKLY", "UTC+8", 4, 0, day_of_week=1, region="asia", is_primary=True),
    Rule("genshin-spiral-abyss", "genshin", "나선 비경 갱신", "CUSTOM_RRULE", "UTC+8", 4, 0, rrule="FREQ=MONTHLY;BYMONTHDAY=16", region="asia"),
    Rule("genshin-imaginarium-theater", "genshin", "현실 속 환상극 시즌 갱신", "MONTHLY", "UTC+8", 4, 0, day_of_month=1, region="asia"),
    Rule("wuwa-daily", "wuwa", "일일 초기화", "DAILY", "UTC+8", 4, 0, region="asia"),
    Rule("wuwa-weekly", "wuwa", "주간 초기화", "WEEKLY", "UTC+8", 4, 0, day_of_week=1, region="asia", is_primary=True),
)

_SCHEMA = """id string, game_id string, name string, frequency string, zone string, is_primary boolean, is_active boolean, freq string,
interval int, times array<int>, weekdays array<struct<weekday:int,nth:int>>, month_days array<int>, anchor date,
until timestamp_ntz, horizon int"""


def _typed(r: Rule) -> tuple:
    custom = r.frequency == "CUSTOM_RRULE"
    p = parse_rrule(r.rrule or "") if custom else Parsed(r.frequency)
    anchor = None
    zone = T.normal_zone_name(r.timezone)
    if custom and r.anchor is not None and zone:
        shift = datetime.strptime(zone, "%z").tzinfo if zone[0] in "+-" else ZoneInfo(zone)
        anchor = r.anchor.replace(tzinfo=UTC).astimezone(shift).date()
    if p.interval > 1 and anchor is None:
        raise RuleError("INTERVAL above 1 needs an anchor")
    clock = sorted(h * 60 + m for h in (p.by_hour or (r.hour,)) for m in (p.by_minute or (r.minute,)))
    weekdays, month_days = list(p.by_day), list(p.by_month_day)
    if p.freq == "WEEKLY" and not weekdays:
        weekdays = [(anchor.isoweekday() if anchor else r.day_of_week or 1, None)]
    if p.freq == "MONTHLY" and not weekdays and not month_days:
        month_days = [anchor.day if anchor else r.day_of_month or 1]
    horizon = {"DAILY": p.interval + 1, "WEEKLY": 7 * p.interval + 1, "MONTHLY": 31 * p.interval * 4 + 1}[p.freq]
    return (r.id, r.game_id, r.name, r.frequency, zone, r.is_primary, r.is_active, p.freq, p.interval, clock, weekdays, month_days, anchor, p.until, horizon)


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = RESET_RULES) -> DataFrame:
    """Typed rules with zones in normal form; a rule with an unknown zone has a null zone and no occurrences."""
    return spark.createDataFrame([_typed(r) for r in rules], _SCHEMA)


def problems(rule: Rule) -> list[str]:
    """What keeps a rule from being used."""
    try:
        _typed(rule)
    except (RuleError, KeyError) as e:
        return [str(e)]
    return [] if 0 <= rule.hour < 24 and 0 <= rule.minute < 60 else ["bad time"]


def without_future(rules: DataFrame, after: Column) -> DataFrame:
    """Active rules that have no occurrence after an instant: ended, or of a zone that is not known."""
    return rules.where("is_active").join(next_occurrence(rules, after).select("id"), "id", "left_anti")


def listed(rules: DataFrame, games: tuple[str, ...] | None = None) -> DataFrame:
    """Active rules, of some games or of all, by game and id."""
    kept = rules.where("is_active")
    return (kept if games is None else kept.where(F.col("game_id").isin(*games) if games else F.lit(False))).orderBy("game_id", "id")


def date_matches(d: Column) -> Column:
    """Whether the rule in this row has an occurrence on the local date ``d``."""
    anchor, every = F.col("anchor"), F.col("interval")
    last = F.dayofmonth(F.last_day(d))
    day = F.dayofmonth(d)
    from_start, from_end = F.floor((day - 1) / 7) + 1, F.floor((last - day) / 7) + 1
    weekday = T.iso_weekday(d)
    on_weekday = F.exists("weekdays", lambda w: (w["weekday"] == weekday) & (w["nth"].isNull() | (w["nth"] == from_start) | (w["nth"] == -from_end)))
    on_month_day = F.exists("month_days", lambda m: day == F.when(m > 0, m).otherwise(last + m + 1))
    week = lambda x: F.date_trunc("week", x).cast("date")
    aligned = (
        F.when(F.col("freq") == "DAILY", F.pmod(F.datediff(d, anchor), every) == 0)
        .when(F.col("freq") == "WEEKLY", F.pmod(F.datediff(week(d), week(anchor)) / 7, every) == 0)
        .otherwise(F.pmod(T.month_index(d) - T.month_index(anchor), every) == 0)
    )
    on_day = F.when(F.col("freq") == "DAILY", True).when(F.col("freq") == "WEEKLY", on_weekday).otherwise(on_weekday | on_month_day)
    return on_day & (anchor.isNull() | ((d >= anchor) & aligned))


def _expanded(rules: DataFrame, first: Column, last: Column) -> DataFrame:
    days = rules.where("is_active and zone is not null").withColumn("day", F.explode(F.sequence(first, last)))
    rows = days.where(date_matches(F.col("day"))).withColumn("minute", F.explode("times"))
    wall = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"))
    at = T.to_instant(wall, F.col("zone"))
    return rows.withColumn("at", at).where(F.col("until").isNull() | (F.col("at") <= F.col("until")))


def occurrences_between(rules: DataFrame, start: Column, end: Column, most: int = 500) -> DataFrame:
    """Rules' columns and ``at`` of the first ``most`` occurrences of each rule in start <= at < end."""
    first, last = F.date_sub(T.local_date(start, F.col("zone")), 1), F.date_add(T.local_date(end, F.col("zone")), 1)
    rows = _expanded(rules, first, last).where((F.col("at") >= start) & (F.col("at") < end))
    return rows.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("day", "minute"))).where(F.col("n") <= most).drop("n")


def next_occurrence(rules: DataFrame, after: Column) -> DataFrame:
    """Rules' columns and ``next_at``, the first occurrence strictly after an instant; rules without one have no row."""
    today = F.date_sub(T.local_date(after, F.col("zone")), 1)
    first = F.greatest(today, F.coalesce("anchor", today))
    rows = _expanded(rules, first, F.date_add(first, F.col("horizon") + 2)).where(F.col("at") > after)
    found = rows.groupBy("id").agg(F.min(F.struct("day", "minute", "at")).alias("x"))
    return rules.join(found, "id").withColumn("next_at", F.col("x.at")).drop("x")


def previous_occurrence(rules: DataFrame, before: Column) -> DataFrame:
    """Rules' columns and ``previous_at``, the last occurrence at or before an instant."""
    last = F.date_add(T.local_date(before, F.col("zone")), 1)
    rows = _expanded(rules, F.date_sub(last, F.col("horizon") + 2), last).where(F.col("at") <= before)
    found = rows.groupBy("id").agg(F.max(F.struct("day", "minute", "at")).alias("x"))
    return rules.join(found, "id").withColumn("previous_at", F.col("x.at")).drop("x")


_DAY_NAMES = {"ko-KR": ("월", "화", "수", "목", "금", "토", "일"), "en-US": ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")}


def describe(rule: Rule, locale: str = "en-US") -> str:
    """A rule in words."""
    clock = f"{rule.hour:02d}:{rule.minute:02d}"
    ko = locale == "ko-KR"
    if rule.frequency == "DAILY":
        return f"매일 {clock}" if ko else f"Daily {clock}"
    if rule.frequency == "WEEKLY":
        day = _DAY_NAMES["ko-KR" if ko else "en-US"][(rule.day_of_week or 1) - 1]
        return f"매주 {day}요일 {clock}" if ko else f"Weekly on {day} {clock}"
    if rule.frequency == "MONTHLY":
        if rule.day_of_month == -1:
            return f"매월 말일 {clock}" if ko else f"Monthly on the last day {clock}"
        return f"매월 {rule.day_of_month or 1}일 {clock}" if ko else f"Monthly on day {rule.day_of_month or 1} {clock}"
    return f"{rule.rrule} {clock}"


