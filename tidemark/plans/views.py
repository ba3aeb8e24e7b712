"""Views of what matters at an instant, each one plan over all games and items."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import model as M
from ..functions import recurrence as R
from ..functions import state as S
from ..functions import times as T
from ..operators.places import numbered


def _classified(items: DataFrame, of: Column, name: str) -> DataFrame:
    """Items with their class, without those that have none. The class comes out of a generator: filters on it then stay
    above it, and the optimizer does not write the long expression into each of them."""
    return items.select("*", F.explode(F.array_compact(F.array(of))).alias(name))


def today(items: DataFrame, rules: DataFrame, now: Column, options: M.TodayOptions = M.TodayOptions()) -> DataFrame:
    """section, kind, id, game_id, title, status, tier, reason, at, priority: the daily digest, most urgent first."""
    kept = items.where(~F.col("id").isin(*options.dismissed)) if options.dismissed else items
    of_items = _classified(S.with_states(kept, now), S.today_section(now, options), "section").withColumn("u", S.urgency(now))
    of_items = of_items.select("section", F.lit("item").alias("kind"), "id", "game_id", "title", F.col("time_status").alias("status"), "u.tier", "u.reason", "u.at", "priority")
    soon = R.next_occurrence(rules, now).where(F.col("next_at") - now <= S.span(options.resets)).withColumn("u", S.reset_urgency(F.col("next_at"), now))
    of_rules = soon.select(F.lit("resets").alias("section"), F.lit("reset").alias("kind"), "id", "game_id", F.col("name").alias("title"), F.lit(None).cast("string").alias("status"), "u.tier", "u.reason", "u.at", F.when(F.col("is_primary"), 60).otherwise(50).alias("priority"))
    # a section holds a large part of all items, so places come from one range sort, not from a window over the section
    return of_items.unionByName(of_rules)


def by_language(title: str) -> Column:
    """A title as readers sort it: by the Unicode collation, not by code points."""
    return F.collate(F.col(title), "UNICODE")


def placed(entries: DataFrame, most: int | None = None) -> DataFrame:
    """Entries with their place in their section; with ``most`` only the first ones, found before the shuffle."""
    order = [F.col("tier"), F.col("at").asc_nulls_last(), F.desc("priority"), by_language("title"), F.col("id")]
    if most is None:
        return numbered(entries, ["section"], order)
    return entries.withColumn("place", F.row_number().over(W.partitionBy("section").orderBy(*order))).where(F.col("place") <= most)


def today_summary(entries: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    s = F.col("section")
    out = entries.agg(count(s == "critical").alias("updates"), count(s == "rewards").alias("rewards"), count((s == "resets") & (F.col("reason") == "RESET_24H")).alias("resets"), count(s == "endingSoon").alias("ending_soon"))
    return out.withColumn("total", F.col("updates") + F.col("rewards") + F.col("resets") + F.col("ending_soon"))


def timeline(items: DataFrame, now: Column, options: M.TimelineOptions = M.TimelineOptions(), by: tuple[str, ...] = ()) -> DataFrame:
    """Items with ``timeline`` (current, upcoming, recent) and ``place`` in it; recent ones up to a limit."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    eff, closed = S.effective(epoch), F.coalesce(F.col("end_at"), S.effective(epoch))
    rows = _classified(S.with_states(items, now), S.timeline_group(now), "timeline")
    far = ((F.col("timeline") == "upcoming") & (eff - now > S.span(options.upcoming))) | ((F.col("timeline") == "recent") & (now - closed > S.span(options.past)))
    key = F.when(F.col("timeline") == "current", F.unix_micros(F.col("end_at").cast("timestamp"))).when(F.col("timeline") == "upcoming", F.unix_micros(eff.cast("timestamp"))).otherwise(-F.unix_micros(closed.cast("timestamp")))
    rows = rows.where(~far).withColumn("sort_key", key)
    order = [F.col("sort_key").asc_nulls_last(), F.col("id")]
    recent = F.col("timeline") == "recent"
    # the limited part is cut per task before it is shuffled; the rest has few groups and no limit, so no group is a task's own
    short = rows.where(recent).withColumn("place", F.row_number().over(W.partitionBy("timeline", *by).orderBy(*order))).where(F.col("place") <= options.recent)
    return numbered(rows.where(~recent), ["timeline", *by], order).unionByName(short).drop("sort_key", "upkeep")


def statuses_by_day(items: DataFrame, first: Column, last: Column) -> DataFrame:
    """instant, time_status, items at each midnight from ``first`` to ``last``.

    A status holds between instants that start, end and threshold give. An item adds one to the day from which it holds and
    takes one from the day after; running sums over the few days then count. Nothing is multiplied by the days.
    """
    start, end = F.col("start_at"), F.col("end_at")
    far = F.lit("9999-01-01").cast("timestamp_ntz")
    soon = F.when(S.is_type("MAINTENANCE"), end).otherwise(end - S.span(M.ENDING_SOON))
    began = F.coalesce(start, F.lit("0001-01-01").cast("timestamp_ntz"))
    over = F.when(end.isNotNull(), F.greatest(end, began)).otherwise(far)  # what ends before it starts is upcoming, then ended
    near = F.least(F.greatest(F.coalesce(soon, far), began), over)

    def day(at: Column) -> Column:
        """The first midnight at or after an instant, kept within the days asked for and the one after."""
        up = F.date_trunc("day", at).cast("timestamp_ntz")
        return F.least(F.greatest(F.when(up < at, up + F.expr("interval 1 day")).otherwise(up), first), last + F.expr("interval 1 day"))

    def span(status: str, a: Column, b: Column) -> list[Column]:
        one = lambda at, n: F.struct(at.alias("instant"), F.lit(status).alias("time_status"), F.lit(n).alias("n"))
        return [one(a, 1), one(b, -1)]

    begin, stop = first, last + F.expr("interval 1 day")
    none = start.isNull() & end.isNull()
    known = F.array(*span("UPCOMING", begin, day(began)), *span("LIVE", day(began), day(near)), *span("ENDING_SOON", day(near), day(over)), *span("ENDED", day(over), stop))
    steps = items.select(F.explode(F.when(none, F.array(*span("UNKNOWN", begin, stop))).otherwise(known)).alias("s")).select("s.*")
    summed = steps.groupBy("instant", "time_status").agg(F.sum("n").alias("n"))
    # days times statuses: a small table whatever the items
    days = summed.select("time_status").distinct().withColumn("instant", F.explode(F.sequence(first, last, F.expr("interval 1 day"))))
    counted = days.join(summed, ["time_status", "instant"], "left").withColumn("items", F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("time_status").orderBy("instant")))
    return counted.where("items > 0").select("instant", "time_status", "items")


def moments() -> Column:
    """array<struct<kind, at>>: the instants at which an item is news."""
    start, end = F.col("start_at"), F.col("end_at")
    published = F.coalesce("source_published_at", "published_at")

    def at(kind: Column | str, when: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), when.alias("at"))

    kind = F.col("type")
    return (
        F.when(S.is_type("PATCH", "UPDATE"), F.array(at(kind, S.effective())))
        .when(S.is_type("EVENT"), F.array(at("EVENT_START", start), at("EVENT_ENDING", end)))
        .when(S.is_type("BANNER"), F.array(at("BANNER_START", start), at("BANNER_END", end)))
        .when(S.is_type("REWARD"), F.array(at(kind, F.coalesce(start, published))))
        .when(S.is_type("REDEEM_CODE"), F.array(at(kind, F.coalesce(published, start))))
        .when(S.is_type("MAINTENANCE"), F.array(at(kind, start)))
        .when(S.is_type("ANNOUNCEMENT"), F.array(at(kind, published)))
    )


def pulse(items: DataFrame, rules: DataFrame, now: Column, past: timedelta = 48 * M.HOUR, future: timedelta = 48 * M.HOUR, daily: bool = False) -> DataFrame:
    """id, kind, at, game_id, title, is_future: items' moments in the closed window, resets in the half-open one."""
    first, last = now - S.span(past), now + S.span(future)
    of_items = items.select("id", "game_id", "title", F.explode(F.filter(moments(), lambda m: m["at"].between(first, last))).alias("m"))
    of_items = of_items.select(F.concat_ws(":", "id", "m.kind").alias("id"), "m.kind", "m.at", "game_id", "title")
    chosen = rules if daily else rules.where("frequency <> 'DAILY'")
    resets = R.occurrences_between(chosen, first, last, 20).select(F.concat_ws(":", "id", F.lit("RESET"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("id"), F.lit("RESET").alias("kind"), "at", "game_id", F.col("name").alias("title"))
    return of_items.unionByName(resets).withColumn("is_future", F.col("at") > now)


def pulse_placed(moments: DataFrame) -> DataFrame:
    """What ``pulse`` gives, numbered by instant; equal ones by id."""
    return numbered(moments, [], [F.col("at"), F.col("id")])


def calendar_placed(entries: DataFrame) -> DataFrame:
    """What ``calendar_entries`` gives, numbered by instant, then title."""
    return numbered(entries, [], [F.col("at"), by_language("title"), F.col("id")])


def snapshot(items: DataFrame, now: Column) -> DataFrame:
    """The facts of each game in one aggregation: ``min_by`` and ``max_by`` combine before the shuffle."""
    kind = F.col("type")
    i = S.with_states(items, now).withColumns({"st": F.col("time_status"), "eff": S.effective(), "kept": F.col("upkeep"), "going": S.active(F.col("time_status"))})
    n = F.col("number")

    def least(when: Column, *by: Column) -> Column:
        return F.min_by(F.when(when, F.col("id")), F.when(when, F.struct(*[b.alias(f"k{j}") for j, b in enumerate(by)])))

    patch = kind == "PATCH"
    soon = (F.col("kept") == "SCHEDULED") & (F.col("start_at") - now <= S.span(M.MAINTENANCE_AHEAD))
    shown = (kind == "MAINTENANCE") & ((F.col("kept") == "IN_PROGRESS") | soon)
    banner, event = (kind == "BANNER") & F.col("going"), (kind == "EVENT") & F.col("going")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return i.groupBy("game_id").agg(
        least(patch & (F.col("eff") <= now), -micros("eff"), n).alias("latest_patch"),
        least(patch & (F.col("st") == "UPCOMING"), F.col("start_at"), n).alias("next_patch"),
        F.count_if(kind.isin("REWARD", "REDEEM_CODE") & S.claimable(S.reward_state(F.col("st")))).alias("rewards_available"),
        F.count_if(event).alias("current_events"),
        least(event & (F.col("st") == "ENDING_SOON"), F.col("end_at"), n).alias("ending_soon_event"),
        least(banner, F.col("end_at").isNull(), F.col("end_at"), n).alias("current_banner"),
        least(shown, F.col("kept") != "IN_PROGRESS", F.coalesce(micros("start_at"), F.lit(0)), n).alias("maintenance"),
        F.max("updated_at").alias("last_updated_at"),
    )


def reset_facts(rules: DataFrame, now: Column) -> DataFrame:
    """game_id, primary_reset, primary_at and the next three resets of each game."""
    nexts = R.next_occurrence(rules, now)
    first = F.min_by("id", F.struct(~F.col("is_primary"), "next_at", "id"))
    at = F.min_by("next_at", F.struct(~F.col("is_primary"), "next_at", "id"))
    three = F.slice(F.sort_array(F.collect_list(F.struct("next_at", "id"))), 1, 3)  # rules of one game: a few
    return nexts.groupBy("game_id").agg(first.alias("primary_reset"), at.alias("primary_at"), F.array_join(F.transform(three, lambda x: x["id"]), ",").alias("next_resets"))


def calendar_entries(items: DataFrame, rules: DataFrame, first: Column, last: Column) -> DataFrame:
    """id, game_id, marker, type, title, at in first <= at < last."""

    def at(marker: str, when: Column) -> Column:
        return F.struct(F.lit(marker).alias("marker"), when.alias("at"))

    release = F.array(at("RELEASE", F.coalesce("start_at", "source_published_at")))
    ends = F.array(at("START", F.col("start_at")), at("END", F.col("end_at")))
    marks = F.when(S.is_type("PATCH", "UPDATE"), release).when(S.is_type(*M.RANGE_TYPES), ends)
    found = F.filter(marks, lambda m: (m["at"] >= first) & (m["at"] < last))
    of_items = items.select("id", "game_id", "type", "title", F.explode(found).alias("m")).select(F.concat_ws(":", "id", "m.marker").alias("id"), "game_id", "m.marker", "type", "title", "m.at")
    resets = R.occurrences_between(rules.where("frequency <> 'DAILY'"), first, last, 62)
    of_rules = resets.select(F.concat_ws(":", "id", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("id"), "game_id", F.lit("RESET").alias("marker"), F.lit(None).cast("string").alias("type"), F.col("name").alias("title"), "at")
    return of_items.unionByName(of_rules)


def month_grid(spark: SparkSession, year: int, month: int, now: Column, zone: str, week_starts_on: int = 7) -> tuple[DataFrame, Column, Column]:
    """Days of the whole weeks around a month (day, week, in_month, is_today), and the instants where the grid begins and ends."""
    first = date(year, month, 1)
    begin = first - timedelta(days=(first.isoweekday() - week_starts_on) % 7)
    after = date(year + month // 12, month % 12 + 1, 1)
    weeks = -(-(after - begin).days // 7)
    end = begin + timedelta(days=7 * weeks)
    day = F.explode(F.sequence(F.lit(begin), F.lit(end - timedelta(days=1)))).alias("day")
    days = spark.range(1).select(day).select("day", F.floor(F.datediff("day", F.lit(begin)) / 7).cast("int").alias("week"), (F.month("day") == month).alias("in_month"), (F.col("day") == T.local_date(now, zone)).alias("is_today"))
    return days, T.start_of_day(F.lit(begin), zone), T.start_of_day(F.lit(end), zone)


def calendar_month(spark: SparkSession, items: DataFrame, rules: DataFrame, year: int, month: int, now: Column, zone: str = "Asia/Seoul") -> DataFrame:
    """Every day of the grid with its entries, days without entries once."""
    days, first, last = month_grid(spark, year, month, now, zone)
    entries = calendar_entries(items, rules, first, last).withColumn("day", T.local_date(F.col("at"), zone))
    # the grid has 42 rows at most, so it is the side to send; days without entries are joined on afterwards
    filled = entries.join(F.broadcast(days), "day")
    empty = days.join(entries.select("day").distinct(), "day", "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True)


def calendar_counts(entries: DataFrame) -> DataFrame:
    """Entries of each day of a grid by marker."""
    count = {m.lower(): F.count_if(F.col("marker") == m) for m in ("START", "END", "RELEASE", "RESET")}
    return entries.groupBy("day", "week", "in_month", "is_today").agg(*[c.alias(f"n_{n}") for n, c in count.items()])


def home(entries: DataFrame, most: int = 8) -> DataFrame:
    """The first highlights: items of all sections but resets and upcoming, in the order of the sections."""
    rows = placed(entries.where("kind = 'item' and section not in ('resets', 'upcoming')"), most)
    return rows.withColumn("rank", M.ranked(F.col("section"), M.TODAY_SECTIONS)).orderBy("rank", "place").limit(most)
