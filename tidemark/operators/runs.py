"""The lock of collecting runs: of an adapter one run at a time.

A run is admitted if no admitted run of its adapter is open; one that has run for too long is given up and holds nobody back.
Whether it is admitted depends on the decisions before it, so no window function gives it. The runs of an adapter pass one
task in order, and all that the task keeps is the run that holds the lock.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE = timedelta(minutes=30)


def admitted(runs: DataFrame, stale: timedelta = STALE) -> DataFrame:
    """adapter_id, run_id, ``admitted``, and ``released``: the admitted run, if any, that this one found stale, of runs
    (adapter_id, run_id, started_at, finished_at: null if it never ends).

    Runs of one adapter come in the order of started_at, then run_id. A run that ends at the instant of another's start is
    over; one is stale if it started more than ``stale`` before. A null start comes first and is never stale."""
    most = stale // timedelta(microseconds=1)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = runs.select(F.col("adapter_id").cast("string"), F.col("run_id").cast("string"), micros("started_at").alias("start"), micros("finished_at").alias("finish"), "started_at", F.col("run_id").alias("_id"))
    ordered = rows.repartition("adapter_id").sortWithinPartitions("adapter_id", F.col("start").asc_nulls_first(), "_id").select("adapter_id", "run_id", "start", "finish")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adapter = holder = begun = ends = None
        first = True
        for batch in batches:
            out, released = [], []
            for a, run, at, finish in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if first or a != adapter:
                    adapter, holder, first = a, None, False
                over = None
                if holder is not None and begun is not None and at is not None and at - begun > most and (ends is None or ends > at):
                    holder, over = None, holder
                free = holder is None or (ends is not None and at is not None and ends <= at)
                if free:
                    holder, begun, ends = run, at, finish
                out.append(free)
                released.append(over)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_()), pa.array(released, pa.string())], ["adapter_id", "run_id", "admitted", "released"])

    return ordered.mapInArrow(scan, "adapter_id string, run_id string, admitted boolean, released string")
