"""Helpers that the operators of this subpackage share: table reading, shared scratch tables, whole-text batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

#: Characters of text that one vectorised step inside a task holds at a time; it bounds memory, not what is read.
STEP_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there, lost executors cost nothing.

    The files go when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark, name)}/table"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing reads any more: what came of it has been written too."""
    spark = table.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def as_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``row``, so that no name of an operator's own can clash with one of them."""
    return F.struct(*[F.col(_quoted(c)) for c in df.columns]).alias("row")


def row_columns(df: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``df`` out of the struct ``row``, those named in ``new`` replaced."""
    return [(new[c] if c in new else F.col(f"row.{_quoted(c)}")).alias(c) for c in df.columns]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = STEP_CHARS) -> Iterator[dict[str, list]]:
    """Columns of consecutive whole rows as lists, so many rows at a time that their texts stay near ``most`` characters."""
    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        texts = cols[text]
        begin = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= most:
                yield {n: c[begin : i + 1] for n, c in cols.items()}
                begin, size = i + 1, 0
        if begin < len(texts):
            yield {n: c[begin:] for n, c in cols.items()}


def in_cells(rows: DataFrame, asked: DataFrame, keys: tuple[str, str], counts: tuple[int, int], size: tuple[int, int], work: Callable, schema: str) -> DataFrame:
    """What ``work(rows, asked)``, two Arrow tables of a cell, gives over all cells of a grid in which every row of ``rows``
    meets every row of ``asked`` once. ``counts``: how many there are of the two; ``size``: how many a cell has of them.

    Rows are dealt by a hash of their ``keys``, which have to differ, so no value they share makes a large cell."""
    down, across = (max(1, -(-n // k)) for n, k in zip(counts, size, strict=True))
    tasks = max(1, down * across // 2)
    left = rows.withColumn("r", F.pmod(F.xxhash64(keys[0]), F.lit(down)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = asked.withColumn("a", F.pmod(F.xxhash64(keys[1], F.lit(1)), F.lit(across)).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    return left.repartition(tasks, "r", "a").groupBy("r", "a").cogroup(right.repartition(tasks, "r", "a").groupBy("r", "a")).applyInArrow(work, schema)


def first_of(groups: np.ndarray, values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first of each group by (value, id)."""
    order = np.lexsort((ids, values, groups))
    g = groups[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[rank < k]
