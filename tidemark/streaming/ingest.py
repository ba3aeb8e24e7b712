"""Incremental ingestion with Structured Streaming.

A stream of candidates goes through the same batch operators as a table does: each micro-batch is decided against the store
and its changes are added to the store. What a batch writes holds from one moment on, and a batch that runs again after that
changes nothing. The store is a few tables of ``segments``: what a batch reads of it does not grow with the store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .. import session
from ..operators import publish as P
from .segments import BUCKET_ROWS, Segments, Table

SIGHTING = ("content_id", "source_id", "source_key")
SIGHTED = "content_id string, source_id string, source_key string, role string, first_seen timestamp_ntz, last_seen timestamp_ntz"
STORED = "source_id string, source_key string, source_type string, semantic_key string, content_hash string, status string, content_id string"


def files(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", per_batch: int = 1000) -> DataFrame:
    """New files below ``path`` as a stream, so many a batch at most that a batch stays bounded."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_batch).load(path)


def changed_only(raw: DataFrame, event_time: str = "fetched_at", horizon: str = "7 days") -> DataFrame:
    """Raw documents whose content has not come with the same hash within ``horizon``: state is dropped after it."""
    return raw.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["source_id", "document_key", "content_hash"])


def windowed_counts(stream: DataFrame, event_time: str, width: str, *by: str, late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rows in tumbling (or, with ``slide``, sliding) windows of event time; what comes later than ``late`` is dropped."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    counted = stream.withWatermark(event_time, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("rows"))
    return counted.select(F.col("w.start").alias("window_start"), *by, "rows")


def sessions(stream: DataFrame, event_time: str, gap: str, *by: str, late: str = "1 day") -> DataFrame:
    """Sessions of each key: rows not more than ``gap`` apart."""
    counted = stream.withWatermark(event_time, late).groupBy(F.session_window(event_time, gap).alias("w"), *by).agg(F.count("*").alias("rows"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "rows")


def requests_within(requests: DataFrame, seconds: int, key: str = "host", at: str = "at") -> DataFrame:
    """Requests with ``recent``: how many of the same key lie within the last ``seconds`` (itself included)."""
    order = F.unix_micros(F.col(at).cast("timestamp"))
    w = W.partitionBy(key).orderBy(order).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return requests.withColumn("recent", F.count("*").over(w))


def _name(kind: str, *parts: str) -> Column:
    """What a record is found by: its source and key, or its meaning. Lengths keep parts of different keys apart."""
    return F.concat(F.lit(kind), *[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), F.col(p))])


class ContentLog:
    """Published content, what sources have reported of it, and the outcomes of candidates, below ``path``.

    Content and sightings are looked up by content id, and ``names`` leads to the ids from a source and key or from a
    meaning. An id stays under a name that it no longer has; the record itself decides then.
    """

    def __init__(self, spark: SparkSession, path: str, now: Column | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path = spark, path
        self.tables = Segments(
            spark,
            path,
            [Table("content", STORED, ["content_id"]), Table("sightings", SIGHTED, SIGHTING, ["content_id"]), Table("names", "name string, content_id string", ["name", "content_id"], ["name"])],
            bucket_rows,
        )
        self.now = F.current_timestamp().cast("timestamp_ntz") if now is None else now

    @property
    def counters(self) -> dict[int, dict[str, int]]:
        """Of each batch whose manifest is kept: discovered, and how many of each outcome and validation."""
        return self.tables.notes()

    def current(self) -> DataFrame:
        return self.tables.all("content")

    def sightings(self) -> DataFrame:
        return self.tables.all("sightings")

    def touched(self, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The records that a batch may touch, and their sightings: those of its keys, those that its sources have reported,
        and those of its meanings."""
        names = candidates.select(F.explode(F.array(_name("k", "source_id", "source_key"), _name("m", "semantic_key"))).alias("name")).where("name is not null").distinct()
        ids = self.tables.look_up("names", names).select("content_id").distinct()
        if self.tables.bucketed("content") or self.tables.bucketed("sightings"):
            ids = session.written(ids, "ids")  # read for the numbers of their buckets, and for the rows
        return self.tables.look_up("content", ids), self.tables.look_up("sightings", ids)

    def apply(self, candidates: DataFrame, batch: int) -> DataFrame:
        """Decide a batch against what stood before it and write what it creates or updates. Returns the outcomes.

        A batch that has been applied is not applied again. All that a batch writes holds from one moment on."""
        path = f"{self.path}/outcomes/batch={batch}"
        if batch <= self.tables.newest():
            return self.spark.read.parquet(path)
        stored, reported = self.touched(candidates)
        # the counters come out of the write itself, so no batch is read again for them
        seen_now = Observation(f"batch {batch}")
        outcomes = P.outcomes(candidates, stored, reported)
        outcomes.observe(seen_now, *P.counters(outcomes)).write.mode("overwrite").parquet(path)
        decided = self.spark.read.schema(outcomes.schema).parquet(path)
        changed = decided.where(F.col("outcome").isin("created", "updated")).select(F.col("owner").alias("content_id")).distinct()
        named = lambda name: decided.where("owner is not null and outcome <> 'review-held'").select(name.alias("name"), F.col("owner").alias("content_id"))
        names = named(_name("k", "source_id", "source_key")).unionByName(named(_name("m", "semantic_key"))).where("name is not null").distinct()
        rows = {
            "content": P.merged(stored, decided).join(changed, "content_id", "left_semi"),
            # of the sightings of a fact that many report only those that are new or changed
            "sightings": P.sighted(reported, decided, self.now).subtract(reported),
            "names": names,
        }
        counters = seen_now.get
        self.tables.commit(batch, rows, 2 * counters["discovered"], counters)
        return decided


def ingest(candidates: DataFrame, log: ContentLog, checkpoint: str, decide: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Start a stream of candidates into the log; it ends when all files that are there have been read."""

    def batch(df: DataFrame, n: int) -> None:
        log.apply(decide(df), n)

    return candidates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """An aggregating stream run over all that is there: the last value of each key. Each batch's changes are written as a
    whole, so a batch that runs again replaces its own."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    out = stream.sparkSession.read.schema(StructType([*stream.schema.fields]).add("batch", "long")).parquet(path)
    return out.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])
