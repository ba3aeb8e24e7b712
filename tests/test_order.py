"""Numbers in groups, windows against items, the lock of runs and the rate limiter against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as V
from tidemark.operators import places as PL
from tidemark.operators import publish as P
from tidemark.operators import runs as RN
from tidemark.plans import feed_queries
from tidemark.streaming import limiter

T0 = datetime(2024, 1, 1)


def test_places_with_one_group_of_most_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(50) if rng.random() < 0.9 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, at int, id int").repartition(5)
    got = {r.id: r.place for r in PL.numbered(df, ["g"], [F.col("at").asc_nulls_last(), F.col("id")]).collect()}
    for g in ("hot", "a", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))
    assert PL.numbered(df.where("false"), ["g"], [F.col("id")]).count() == 0
    # no window sorts rows of the table by their group
    plan = PL.numbered(df, ["g"], [F.col("id")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "_rows" in plan.split("Window")[1]


def test_slugs(spark):
    rows = [("s", "3"), ("s", "1"), ("t", "5"), ("s", "2"), (None, "9")]
    got = {r.id: r.slug for r in P.unique_slugs(spark.createDataFrame(rows, "slug string, id string")).collect()}
    assert (got["1"], got["5"], got["9"]) == ("s", "t", None)
    assert got["2"] != got["3"] and got["2"].startswith("s-") and got["3"].startswith("s-")


@pytest.mark.parametrize(("seed", "span", "unit"), [(1, 40, 1), (2, 2000, 1), (3, 300, 24), (4, 1, 1), (5, 90, 7)])
def test_windows_touch_what_they_touch(spark, seed, span, unit):
    rng = random.Random(seed)
    hour = lambda n: T0 + timedelta(minutes=60 * n + rng.choice([0, 0, 1, 30]))
    items = []
    for i in range(150):
        a = rng.randrange(-span, 2 * span)
        items.append((i, None if rng.random() < 0.15 else hour(a), None if rng.random() < 0.15 else hour(a + rng.choice([-1, 0, 0, 1, 5, span]))))
    windows = [(j, None if rng.random() < 0.05 else hour(a := rng.randrange(span)), hour(a + rng.choice([-1, 0, 1, 3, span]))) for j in range(60)]
    got = V.touching(spark.createDataFrame(items, "id int, start_at timestamp_ntz, end_at timestamp_ntz"), spark.createDataFrame(windows, "window_id int, first timestamp_ntz, last timestamp_ntz"), timedelta(hours=unit))
    want = sorted((i, j) for i, s, e in items for j, a, b in windows if a and a <= b and not (s and e and s > e) and (s is None or s <= b) and (e is None or e >= a))
    assert sorted(map(tuple, got.collect())) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("seed", "span", "n"), [(1, 40, 150), (2, 2000, 150), (3, 1, 80), (4, 90, 0)])
def test_windows_are_tallied_as_they_touch(spark, seed, span, n):
    rng = random.Random(seed)
    hour = lambda n: T0 + timedelta(minutes=60 * n + rng.choice([0, 0, 1, 30]))
    items = []
    for _ in range(n):
        a = rng.randrange(-span, 2 * span)
        items.append((None if rng.random() < 0.1 else rng.randrange(500), None if rng.random() < 0.15 else hour(a), None if rng.random() < 0.15 else hour(a + rng.choice([-1, 0, 0, 1, 5, span]))))
    # ids repeat, and one is null
    windows = [(j % 50 or None, None if rng.random() < 0.05 else hour(a := rng.randrange(span)), hour(a + rng.choice([-1, 0, 1, 3, span]))) for j in range(60)]
    got = V.tallied(spark.createDataFrame(items, "id int, start_at timestamp_ntz, end_at timestamp_ntz"), spark.createDataFrame(windows, "window_id int, first timestamp_ntz, last timestamp_ntz"))
    want = {}
    for i, s, e in items:
        for j, a, b in windows:
            if a and a <= b and not (s and e and s > e) and (s is None or s <= b) and (e is None or e >= a):
                want.setdefault(j, []).append(i)
    assert {r.window_id: (r.items, r.first_item) for r in got.collect()} == {j: (len(x), min((i for i in x if i is not None), default=None)) for j, x in want.items()}


def _most_rows(plan):
    """Rows of the operator that made most of them, of a plan that has run."""
    if "finalPhysicalPlan" in dir(plan):
        plan = plan.finalPhysicalPlan()
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return _most_rows(plan.plan())
    own = plan.metrics().get("numOutputRows")
    below = plan.children()
    return max([own.get().value() if own.isDefined() else 0, *[_most_rows(below.apply(i)) for i in range(below.size())]])


def test_window_matches_makes_no_pairs(spark, tmp_path):
    """The items that touch a window are counted without a row for each."""
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") % 700).cast("int"))
    made = {"event_id": F.col("id"), "ts": ts, "user_id": F.col("id") % 97, "event_type": F.lit("click"), "value": (F.col("id") % 90).cast("double"), "props": F.lit("{}")}
    spark.range(20_000).select(*[made[f.name].cast(f.dataType).alias(f.name) for f in base.fields]).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    df = feed_queries.window_matches(spark, str(tmp_path))
    pairs = sum(r["items"] for r in df.collect())
    assert pairs > 5_000_000
    assert _most_rows(df._jdf.queryExecution().executedPlan()) < pairs / 50


def test_no_windows(spark):
    items = spark.createDataFrame([(1, None, None)], "id int, start_at timestamp_ntz, end_at timestamp_ntz")
    assert V.touching(items, spark.createDataFrame([(1, T0, None)], "window_id int, first timestamp_ntz, last timestamp_ntz")).count() == 0


def lock(runs, stale):
    out, held = {}, {}
    for a, run, at, finish in sorted(runs, key=lambda r: (r[0] or "", r[2] or datetime.min, r[1])):
        over = None
        if a in held and at and held[a][1] and at - held[a][1] > stale and not (held[a][2] and held[a][2] <= at):
            over = held.pop(a)[0]
        free = a not in held or bool(held[a][2] and at and held[a][2] <= at)
        if free:
            held[a] = (run, at, finish)
        out[run] = (free, over)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_lock_goes_to_one_run_at_a_time(spark, seed):
    rng = random.Random(seed)
    runs = []
    for i in range(400):
        at = T0 + timedelta(minutes=rng.randrange(600))
        runs.append((rng.choice("aaaab"), f"r{i:03}", at, None if rng.random() < 0.2 else at + timedelta(minutes=rng.randrange(0, 60))))
    got = RN.admitted(spark.createDataFrame(runs, "adapter_id string, run_id string, started_at timestamp_ntz, finished_at timestamp_ntz").repartition(5))
    assert {r.run_id: (r.admitted, r.released) for r in got.collect()} == lock(runs, RN.STALE)


def test_a_chain_of_runs(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    runs = [("a", "1", at(0), at(10)), ("a", "2", at(5), at(6)), ("a", "3", at(9), at(30)), ("a", "4", at(10), None), ("a", "5", at(40), at(41)), ("a", "6", at(41), at(42)), ("b", "7", at(5), at(6)), ("a", "8", None, None)]
    df = spark.createDataFrame(runs, "adapter_id string, run_id string, started_at timestamp_ntz, finished_at timestamp_ntz")
    assert {r.run_id: (r.admitted, r.released) for r in RN.admitted(df.where("started_at is not null")).collect()} == {"1": (True, None), "2": (False, None), "3": (False, None), "4": (True, None), "5": (False, None), "6": (True, "4"), "7": (True, None)}
    assert RN.admitted(df).where("admitted").count() == 2  # a run without a start that never ends keeps the lock
    assert RN.admitted(df.where("false")).count() == 0


def grants(events, policy, until):
    """Grants of one host after another, event by event."""
    interval, apart = policy.milliseconds
    out = {}
    for host in {e.host for e in events}:
        mine = sorted(((int((e.at - datetime(1970, 1, 1)) / timedelta(milliseconds=1)), e.kind, e.id, e.until, e.server_limit) for e in events if e.host == host), key=lambda e: e[:3])
        starts, blocked, limit, queue = [], 0, None, []

        def turn():
            t = max(queue[0][0], blocked, starts[-1] if starts else 0)
            while True:  # as a client does that sleeps and looks again
                recent = [s for s in starts if s > t - interval]
                wait = recent[0] + interval - t if len(recent) >= policy.limit else max(0, starts[-1] + apart - t) if starts else 0
                if wait <= 0:
                    return t
                t += wait

        for at, kind, name, pause, told in [*mine, (until + 1, "end", "", None, None)]:
            while queue and turn() < at:
                t = turn()
                asked, who = queue.pop(0)
                starts.append(t)
                out[who] = (host, asked, t, limit)
            if kind == "request":
                queue.append((at, name))
            else:
                blocked, limit = max(blocked, pause or 0), told if told is not None else limit
    return out


def test_grants_are_those_of_a_client_that_waits(spark, sf_dir):
    events = feed_queries.limited_events(spark, sf_dir).collect()
    last = max(int((e.at - datetime(1970, 1, 1)) / timedelta(milliseconds=1)) for e in events)
    got = feed_queries.rate_grants(spark, sf_dir).collect()
    want = grants(events, feed_queries.POLICY, last)
    assert {r.id: (r.host, r.asked_ms, r.granted_ms, r.server_limit) for r in got} == want
    assert len(got) == len(want) and any(r.granted_ms > r.asked_ms for r in got) and any(r.server_limit for r in got)


def test_headers_of_answers(spark):
    at = T0
    rows = [("h", 1, at, 200, "5", "3", "60", None), ("h", 2, at, 200, None, "0", "60", None), ("h", 3, at, 429, None, None, None, "10"), ("h", 4, at, 429, "x", None, "20", None), ("h", 5, at, 503, None, None, "20", None), ("h", 6, at, 503, None, "0", "5", "7"), ("h", 7, at, 200, "-1", "0", None, "9")]
    df = limiter.answers(spark.createDataFrame(rows, "host string, id int, at timestamp_ntz, status int, limit string, remaining string, reset string, retry_after string"))
    base = int((T0 - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
    assert [(r.until and (r.until - base) // 1000, r.server_limit) for r in df.orderBy("id").collect()] == [(None, 5), (60, None), (10, None), (20, None), (None, None), (7, None), (None, None)]


def test_titles_by_language(spark):
    from tidemark.plans.views import placed

    titles = ["Z", "b", "a", "A", "ab", "a-b", "가", "10", "2", "나", "É", "e", "f"]
    rows = [("s", 1, T0, 50, t, str(i)) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "section string, tier int, at timestamp_ntz, priority int, title string, id string")
    for got in (placed(df), placed(df, 20)):
        assert [r.title for r in got.orderBy("place").collect()] == ["10", "2", "a", "A", "a-b", "ab", "b", "e", "É", "f", "Z", "가", "나"]
