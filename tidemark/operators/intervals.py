"""Which items touch which windows, for any number of both, as an equi-join.

Time is a tree: leaves of one ``unit``, each node two below it. An interval is covered by few nodes, at most two a level,
however long it is; an instant lies below one node a level. An item and a window touch if the window begins inside the item,
or the item begins inside the window, after its beginning; never both. So items' covers meet windows' beginnings, and windows'
covers meet items' beginnings, on the node, and each pair is met once. Leaves are coarse, so instants are compared after that.
No interval is multiplied by its length and nothing is compared that shares no node.

``tallied`` asks how many items touch each window and makes no pairs, of which there are as many as items times windows. Its
leaves are the windows' own beginnings and ends in their order, so nothing has to be compared after the nodes have met: items
are summed up by node, and each window looks up the sums of its nodes. An item learns its leaves by being sorted among them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from .. import session


def _leaf(at: Column, origin: Column, unit: timedelta) -> Column:
    return F.floor((F.unix_micros(at.cast("timestamp")) - origin) / F.lit(unit // timedelta(microseconds=1)))


def _node(level: Column, index: Column) -> Column:
    return F.shiftleft(level.cast("long"), 48) + index


def above(leaf: Column, levels: int) -> Column:
    """The nodes that a leaf lies below, itself included."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda n: _node(n, F.call_function("shiftright", leaf, n)))


def cover(low: Column, high: Column, levels: int) -> Column:
    """The fewest nodes below which lie the leaves from ``low`` to ``high`` and no others."""

    def climb(x: Column, level: Column) -> Column:
        lo, hi = x["lo"], x["hi"]
        left = F.when((lo <= hi) & (lo % 2 == 1), F.array(_node(level, lo))).otherwise(F.array().cast("array<bigint>"))
        right = F.when((lo <= hi) & (hi % 2 == 0), F.array(_node(level, hi))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(F.shiftright(lo + 1, 1).alias("lo"), F.shiftright(hi - 1, 1).alias("hi"), F.concat(x["nodes"], left, right).alias("nodes"))

    start = F.struct(low.cast("long").alias("lo"), high.cast("long").alias("hi"), F.array().cast("array<bigint>").alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, climb, lambda x: x["nodes"])


def touching(items: DataFrame, windows: DataFrame, unit: timedelta = timedelta(hours=1)) -> DataFrame:
    """Every pair of an item (id, start_at, end_at) and a window (window_id, first, last) that share an instant: id, window_id.

    Both are closed. A null start or end of an item reaches without end; a window without a bound, or that ends before it
    begins, touches nothing, nor does an item that ends before it begins."""
    windows = windows.where("first <= last")
    reach = windows.agg(F.min("first").alias("a"), F.max("last").alias("b")).first()  # two instants
    if reach.a is None:
        return items.select("id").join(windows.select("window_id").where("false"), how="cross").where("false")
    begin, end = F.lit(reach.a), F.lit(reach.b)
    origin = F.unix_micros(begin.cast("timestamp"))
    levels = int((reach.b - reach.a) / unit).bit_length() + 1
    kept = items.where("start_at is null or end_at is null or start_at <= end_at").where((F.col("start_at").isNull() | (F.col("start_at") <= end)) & (F.col("end_at").isNull() | (F.col("end_at") >= begin)))
    leaf = lambda c: _leaf(c, origin, unit)
    whole = cover(leaf(F.greatest(F.coalesce("start_at", begin), begin)), leaf(F.least(F.coalesce("end_at", end), end)), levels)
    starts = F.when(F.col("start_at") >= begin, above(leaf(F.col("start_at")), levels)).otherwise(F.array().cast("array<bigint>"))
    of = lambda nodes, inside: F.transform(nodes, lambda n: F.struct(F.lit(inside).alias("inside"), n.alias("node")))
    left = kept.select("id", "start_at", "end_at", F.explode(F.concat(of(whole, False), of(starts, True))).alias("k")).select("id", "start_at", "end_at", "k.*")
    right = windows.select("window_id", "first", "last", F.explode(F.concat(of(above(leaf(F.col("first")), levels), False), of(cover(leaf(F.col("first")), leaf(F.col("last")), levels), True))).alias("k")).select("window_id", "first", "last", "k.*")
    met = left.join(right, ["inside", "node"])
    begins_in_item = (F.col("start_at").isNull() | (F.col("start_at") <= F.col("first"))) & (F.col("end_at").isNull() | (F.col("end_at") >= F.col("first")))
    begins_in_window = (F.col("start_at") > F.col("first")) & (F.col("start_at") <= F.col("last"))
    return met.where(F.when(F.col("inside"), begins_in_window).otherwise(begins_in_item)).select("id", "window_id")


def _count_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends how many marks a partition has up to each row."""
    before = 0
    for batch in batches:
        counts = np.cumsum(batch.column(batch.schema.get_field_index("_mark")).to_numpy(zero_copy_only=False).astype(np.int64)) + before
        before = int(counts[-1]) if len(counts) else before
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], [*batch.schema.names, "_marks"])


def _ranked(rows: DataFrame, at: str, marks: DataFrame, name: str, inclusive: bool) -> DataFrame:
    """``rows`` with ``name``: how many of the distinct instants ``marks`` (at) lie before ``at``, or at it if ``inclusive``; 0 for null.

    Rows and marks are dealt by ranges of the instant, and rows of one instant further by a hash of theirs. A task counts the
    marks that it has, so that only these counts, a row a task, are looked at together."""
    points = rows.withColumns({"_at": F.col(at), "_mark": F.lit(False)}).unionByName(marks.select(F.col("at").alias("_at"), F.lit(True).alias("_mark")), allowMissingColumns=True)
    order = [F.col("_at"), F.desc("_mark") if inclusive else F.asc("_mark"), F.xxhash64(*rows.columns)]
    dealt = points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    found = session.written(dealt.mapInArrow(_count_marks, Y.StructType([*dealt.schema.fields, Y.StructField("_marks", Y.LongType())])), "ranks")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = found.groupBy("_part").agg(F.count_if("_mark").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return found.where("not _mark").join(parts, "_part").select(*rows.columns, (F.col("_before") + F.col("_marks")).alias(name))


def tallied(items: DataFrame, windows: DataFrame) -> DataFrame:
    """Of each window_id that some item touches: ``items``, how many pairs ``touching`` has of it, and ``first_item``, the least id in them."""
    windows = windows.where("first <= last").select("window_id", "first", "last")
    marks = session.written(windows.select(F.col("first").alias("at")).union(windows.select("last")).distinct(), "marks")
    many = marks.count()
    levels = many.bit_length() + 1
    # written before the rows are left out: a condition on how they came to be would compute them many times over
    kept = session.written(items.select("id", "start_at", "end_at"), "items").where("start_at is null or end_at is null or start_at <= end_at")
    # an item's leaves are lo..hi; between two marks it has none (hi = lo - 1), but begins before lo all the same
    placed = _ranked(_ranked(kept, "start_at", marks, "lo", False), "end_at", marks, "hi", True)
    hi = F.when(F.col("end_at").isNull(), F.lit(many)).otherwise(F.col("hi")) - 1
    alike = session.written(placed.groupBy("lo", hi.alias("hi")).agg(F.count("*").alias("n"), F.min("id").alias("least")), "spans")
    of = lambda nodes, inside: F.transform(nodes, lambda n: F.struct(F.lit(inside).alias("inside"), n.alias("node")))
    sums = (F.sum("n").alias("n"), F.min("least").alias("least"))
    whole = alike.select("n", "least", F.explode(of(cover(F.col("lo"), F.col("hi"), levels), False)).alias("k"))
    # one without a beginning has lo = 0, which lies after no window's
    starts = alike.groupBy("lo").agg(*sums).select("n", "least", F.explode(of(above(F.col("lo"), levels), True)).alias("k"))
    nodes = whole.unionByName(starts).groupBy("k.inside", "k.node").agg(*sums)
    ranked = _ranked(_ranked(windows, "first", marks, "f", False), "last", marks, "g", False)
    sides = F.concat(of(above(F.col("f"), levels), False), of(cover(F.col("f") + 1, F.col("g"), levels), True))
    asked = ranked.select("window_id", F.explode(sides).alias("k")).select("window_id", "k.*")
    return asked.join(nodes, ["inside", "node"]).groupBy("window_id").agg(F.sum("n").alias("items"), F.min("least").alias("first_item"))
