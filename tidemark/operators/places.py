"""Numbers of rows in their groups without a task that sorts a whole group.

Rows are dealt by ranges of (group, order), so a group that holds most rows is spread over many tasks. Each task counts its
part of a group; a part begins where the parts before it end. Only these counts, a row for each group and task, are ever
looked at together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with ``name``, their number from 1 in their group of equal ``by`` (null is a value), in ``order``.

    The order has to tell all rows of a group apart; rows that it does not are numbered in any order. Rows are written to the
    shared folder once, so that numbers stay the same if an executor is lost."""
    dealt = rows.repartitionByRange(*[F.col(c) for c in by], *order).sortWithinPartitions(*[F.col(c) for c in by], *order)
    # partition in the upper bits, row inside it in the lower
    found = session.written(dealt.withColumn("_at", F.monotonically_increasing_id()), "places")
    part = F.shiftright("_at", 33)
    parts = found.groupBy(*by, part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).select(*[F.col(c).alias(f"_{c}") for c in by], "_part", "_first", "_before")
    same = part == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = found.join(offsets, same).withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int"))
    return placed.select(*rows.columns, name)
