"""The content log on segments: equal to a log that is read whole, flat reads, and nothing lost between two writes."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import publish as P
from tidemark.streaming import ingest
from tidemark.streaming.segments import FANOUT, Segments, Table

CANDIDATES = "source_id string, source_type string, source_key string, number bigint, semantic_key string, content_hash string, decision string"


def batches(n, size, seed=3):
    """Half of a batch is about one fact."""
    draw = random.Random(seed)
    kinds = {"s1": "OFFICIAL_API", "s2": "MANUAL", "s3": "MANUAL"}
    for b in range(n):
        rows = []
        for i in range(size):
            s = draw.choice(sorted(kinds))
            fact = "f0" if draw.random() < 0.5 else draw.choice([None, *(f"f{x}" for x in range(1, 30))])
            rows.append((s, kinds[s], f"k{draw.randrange(40)}", b * size + i, fact, f"h{draw.randrange(3)}", draw.choice(["PUBLISHED", "PUBLISHED", "PENDING_REVIEW", None])))
        yield rows


def rows_of(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_log_equals_whole_store(spark, tmp_path):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    log = ingest.ContentLog(spark, f"file://{tmp_path}/log", now, bucket_rows=8)
    stored, reported = spark.createDataFrame([], ingest.STORED), spark.createDataFrame([], ingest.SIGHTED)
    for n, rows in enumerate(batches(4, 40)):
        df = spark.createDataFrame(rows, CANDIDATES)
        whole = P.outcomes(df, stored, reported)
        got = log.apply(df, n)
        assert rows_of(got, ["number", "outcome", "owner"]) == rows_of(whole, ["number", "outcome", "owner"]), n
        # the whole store by way of the driver, so that no lineage grows in the test
        stored, reported = (spark.createDataFrame(x.collect(), s) for x, s in ((P.merged(stored, whole), P.merged(stored, whole).schema), (P.sighted(reported, whole, now), ingest.SIGHTED)))
        columns = [c.split()[0] for c in ingest.STORED.split(", ")]
        assert rows_of(log.current(), columns) == rows_of(stored, columns)
        assert rows_of(log.sightings(), reported.columns) == rows_of(reported, reported.columns)
    assert log.tables.bucketed("content") and sum(c["discovered"] for c in log.counters.values()) == 160
    # what failed writers and old manifests have left goes, the store stays
    before = rows_of(log.current(), columns)
    assert log.tables.clean(keep=1) > 0 and log.tables.clean(keep=1) == 0 and rows_of(log.current(), columns) == before


TABLE = Table("t", "k bigint, v bigint", ["k"])


def test_reads_stay_flat(spark, tmp_path):
    store = Segments(spark, f"file://{tmp_path}/s", [TABLE], bucket_rows=64)
    asked, read = spark.createDataFrame([(5,), (77,)], "k bigint"), []
    for n in range(10):
        store.commit(n, {"t": spark.range(n * 200, n * 200 + 256).select(F.col("id").alias("k"), F.lit(n).cast("bigint").alias("v"))}, 256, {})
        read.append(store.rows_for("t", asked).count())
        segments = store.manifest()["segments"]["t"]
        assert all(sum(s["level"] == x["level"] for s in segments) < FANOUT for x in segments)
    assert sum(s["rows"] for s in segments) >= 2056 and max(read) < 2 * FANOUT * 64 * 2
    # keys that two batches have are what the later one says
    got = {r.k: r.v for r in store.all("t").collect()}
    assert got == {k: min(k // 200, 9) for k in range(9 * 200 + 256)}
    assert {r.k: r.v for r in store.look_up("t", asked).collect()} == {5: 0, 77: 0}


def test_crash_before_the_switch(spark, tmp_path, monkeypatch):
    store = Segments(spark, f"file://{tmp_path}/s", [TABLE], bucket_rows=4)
    table = lambda n: {"t": spark.range(n * 10, n * 10 + 10).select(F.col("id").alias("k"), F.lit(n).cast("bigint").alias("v"))}
    for n in range(FANOUT - 1):
        store.commit(n, table(n), 10, {})
    before = store.manifest()
    merged = Segments._merged
    with monkeypatch.context() as m:
        m.setattr(Segments, "_merged", lambda self, t, s: merged(self, t, s) and 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.commit(FANOUT - 1, table(FANOUT - 1), 10, {})
    assert store.newest() == FANOUT - 2 and store.manifest() == before and store.all("t").count() == 30
    store.commit(FANOUT - 1, table(FANOUT - 1), 10, {})
    assert store.all("t").count() == 40
    with pytest.raises(RuntimeError):
        store.commit(FANOUT - 1, table(9), 10, {})
    assert store.all("t").count() == 40


def test_empty(spark, tmp_path):
    log = ingest.ContentLog(spark, f"file://{tmp_path}/log")
    assert log.current().count() == 0 == log.sightings().count() and log.counters == {}
    assert log.apply(spark.createDataFrame([], CANDIDATES), 0).count() == 0 and log.current().count() == 0
