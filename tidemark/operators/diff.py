"""Differences of two snapshots, and the direction of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def direction(before: Column, after: Column, lower_is_better: bool = False) -> Column:
    """BUFF, NERF or ADJUST for arrays of ranks: the shorter one goes on with its last value; ups and downs together, or
    neither, are an adjustment."""
    n = F.greatest(F.size(before), F.size(after))
    pad = lambda a: F.concat(a, F.array_repeat(F.element_at(a, -1), n - F.size(a)))
    change = F.zip_with(pad(before), pad(after), lambda x, y: F.signum(y - x))
    up, down = F.exists(change, lambda c: c > 0), F.exists(change, lambda c: c < 0)
    good, bad = (down, up) if lower_is_better else (up, down)
    return F.when(good & ~bad, "BUFF").when(bad & ~good, "NERF").otherwise("ADJUST")


def number_text(x: Column) -> Column:
    """A whole number as such, others with four decimals at most."""
    short = F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(short)


def ranks_text(values: Column) -> Column:
    """One value if all are equal, else all of them with slashes."""
    text = F.transform(values, number_text)
    return F.when(F.size(F.array_distinct(text)) <= 1, F.element_at(text, 1)).otherwise(F.array_join(text, "/"))


def entities(previous: DataFrame, current: DataFrame, key: str, fields: dict[str, bool], name: str) -> DataFrame:
    """One row for each difference: NEW, REMOVED, or a change of a numeric field (True: lower is better) with the values
    before and after. Unchanged fields give none, fields missing on one side count as 0."""
    p = previous.select(key, F.struct(name, *fields).alias("p"))
    c = current.select(key, F.struct(name, *fields).alias("c"))
    both = p.join(c, key, "full_outer").select(key, "p", "c", F.coalesce(f"c.{name}", f"p.{name}").alias("name"))

    def change(field: str, lower: bool) -> Column:
        a, b = (F.coalesce(F.col(f"{side}.{field}").cast("double"), F.lit(0.0)) for side in "pc")
        row = F.struct(F.lit(field).alias("field"), direction(F.array(a), F.array(b), lower).alias("change"), a.alias("before"), b.alias("after"))
        return F.when(F.col("p").isNotNull() & F.col("c").isNotNull() & (a != b), row)

    none = F.lit(None)
    whole = F.when(F.col("p").isNull(), "NEW").when(F.col("c").isNull(), "REMOVED")
    one = F.when(whole.isNotNull(), F.struct(none.cast("string").alias("field"), whole.alias("change"), none.cast("double").alias("before"), none.cast("double").alias("after")))
    rows = both.select(key, "name", F.explode(F.array_compact(F.array(one, *[change(f, low) for f, low in fields.items()]))).alias("d"))
    return rows.select(key, "name", "d.*")


CHANGE = "array<struct<change:string,field:string,before:string,after:string,unit:string>>"


def _change(change: Column, field: Column, before: Column, after: Column, unit: str | None = None) -> Column:
    return F.struct(change.alias("change"), field.alias("field"), before.alias("before"), after.alias("after"), F.lit(unit).cast("string").alias("unit"))


def stat_changes(before: Column, after: Column, missing_is_zero: bool, ignored: tuple[str, ...] = ()) -> Column:
    """Changes of two maps of numbers by key, keys in order. Keys of one side only count as 0 there, or give no change."""
    keys = F.map_keys(after) if not missing_is_zero else F.array_union(F.map_keys(before), F.map_keys(after))
    keys = F.array_sort(F.filter(keys, lambda k: ~k.isin(*ignored)) if ignored else keys)
    value = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0.0)) if missing_is_zero else F.element_at(m, k)
    one = lambda k: F.when(value(before, k) != value(after, k), _change(direction(F.array(value(before, k)), F.array(value(after, k))), k, number_text(value(before, k)), number_text(value(after, k))))
    return F.array_compact(F.transform(keys, one)).cast(CHANGE)


#: Fields of an ability, whether lower is better, and their unit.
SPELL_FIELDS = (("cooldown", True, "초"), ("cost", True, None), ("range", False, None))


def spell_changes(before: Column, after: Column, slots: tuple[str, ...] = ("Q", "W", "E", "R")) -> Column:
    """Changes of abilities that stand at the same place on both sides."""
    names = F.array(*[F.lit(s) for s in slots])

    def of(pair: Column, i: Column) -> Column:
        a, b = pair["before"], pair["after"]
        slot = F.coalesce(F.get(names, i), F.lit(slots[-1]))
        rows = [F.when(a[f] != b[f], _change(direction(a[f], b[f], low), F.concat_ws(" ", slot, b["name"], F.lit(f)), ranks_text(a[f]), ranks_text(b[f]), unit)) for f, low, unit in SPELL_FIELDS]
        return F.when(a.isNotNull() & b.isNotNull(), F.array_compact(F.array(*rows))).otherwise(F.array().cast(CHANGE))

    return F.flatten(F.transform(F.arrays_zip(before.alias("before"), after.alias("after")), of)).cast(CHANGE)


def _whole(change: str) -> Column:
    none = F.lit(None).cast("string")
    return F.array(_change(F.lit(change), none, none, none)).cast(CHANGE)


def champion_changes(previous: DataFrame, current: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """target_type, target_key, target_name and a change a row; a champion that is gone gives none."""
    p = previous.select("id", F.struct("stats", "spells").alias("p"))
    both = current.join(p, "id", "left")
    changes = F.when(F.col("p").isNull(), _whole("NEW")).otherwise(F.concat(stat_changes(F.col("p.stats"), F.col("stats"), False, ignored), spell_changes(F.col("p.spells"), F.col("spells"))))
    return both.select(F.lit("CHAMPION").alias("target_type"), F.col("id").alias("target_key"), F.col("name").alias("target_name"), F.posexplode(changes).alias("position", "c")).select("target_type", "target_key", "target_name", "position", "c.*")


def item_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The same of items: new, removed, or the price (lower is better) and stats of those on both sides."""
    side = lambda df, n: df.select("id", F.struct("name", "gold", "stats").alias(n))
    both = side(previous, "p").join(side(current, "c"), "id", "full_outer")
    gold = F.when(F.col("p.gold") != F.col("c.gold"), F.array(_change(direction(F.array("p.gold"), F.array("c.gold"), True), F.lit("gold"), number_text(F.col("p.gold")), number_text(F.col("c.gold"))))).otherwise(F.array().cast(CHANGE))
    changes = F.when(F.col("p").isNull(), _whole("NEW")).when(F.col("c").isNull(), _whole("REMOVED")).otherwise(F.concat(gold.cast(CHANGE), stat_changes(F.col("p.stats"), F.col("c.stats"), True)))
    return both.select(F.lit("ITEM").alias("target_type"), F.col("id").alias("target_key"), F.coalesce("c.name", "p.name").alias("target_name"), F.posexplode(changes).alias("position", "c")).select("target_type", "target_key", "target_name", "position", "c.*")


def diff_summary(changes: DataFrame) -> DataFrame:
    """How many changes, and entities touched, of each type."""
    return changes.groupBy("target_type").agg(F.count("*").alias("changes"), F.countDistinct("target_key").alias("touched"))


def change_line(name: Column, field: Column, before: Column, after: Column) -> Column:
    """``name field before → after``, or without the values if one is missing."""
    head = F.concat_ws(" ", name, field)
    return F.when(before.isNotNull() & after.isNotNull(), F.concat(head, F.lit(" "), before, F.lit(" → "), after)).otherwise(head)


def groups_in_order(changes: DataFrame, by: str, group: str, position: str) -> DataFrame:
    """Changes of each ``by`` counted per group, with the group's place by first sight."""

    g = changes.groupBy(by, group).agg(F.min(position).alias("first_position"), F.count("*").alias("changes"))
    return g.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("first_position", group)))


def limited(changes: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` changes of each group in their order, with ``truncated``: whether the group had more. Counts combine
    before they are shuffled, and so does the cut."""
    w = W.partitionBy(*by).orderBy(*order)
    kept = changes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    sizes = changes.groupBy(*by).agg((F.count("*") > most).alias("truncated"))
    return kept.join(sizes, by)
