"""Publication of candidates against a plain run, candidate by candidate."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import model as M
from tidemark.operators import publish as P

ROWS = "source_id string, source_type string, source_key string, semantic_key string, content_hash string, decision string, number int"
EMPTY = "content_id string, " + ", ".join(f"{c} string" for c in P.STORE)
AT = datetime(2024, 1, 1)
SOURCES = {"a": "OFFICIAL_API", "b": "OFFICIAL_WEB", "c": "OFFICIAL_WEB", "d": "TRUSTED_FALLBACK"}


class Plain:
    """A store that takes one candidate after the other."""

    def __init__(self):
        self.records, self.seen, self.index = {}, {}, {}

    def take(self, source, key, meaning, hash_, decision):
        """Outcome and the record's number."""
        if decision is None:
            return "rejected", None
        stronger = lambda other: M.AUTHORITY[SOURCES[source]] < M.AUTHORITY[SOURCES[other]]
        at = self.index.get((source, key))
        if at is None:
            at = next((r for r, rows in self.seen.items() if (source, key) in rows), None)
        target, over = at, None
        if at is not None and self.records[at]["source"] != source:
            if not stronger(self.records[at]["source"]):
                self.seen[at][source, key] = "SUPPORTING"
                return "duplicate", at
            over = at
        elif at is None:
            others = sorted((M.AUTHORITY[SOURCES[r["source"]]], n) for n, r in self.records.items() if r["meaning"] == meaning and r["source"] != source)
            if others:
                target = others[0][1]
                if not stronger(self.records[target]["source"]):
                    self.seen[target][source, key] = "SUPPORTING"
                    return "duplicate", target
                over = target
        if decision == "PENDING_REVIEW" and target is not None and self.records[target]["status"] == "PUBLISHED":
            return "review-held", target
        mine = over if over is not None else self.index.get((source, key))
        new = dict(source=source, key=key, meaning=meaning, hash=hash_, status=decision)
        if mine is None:
            mine = len(self.records)
            self.records[mine], self.seen[mine], outcome = new, {}, "created"
        elif (self.records[mine]["source"], self.records[mine]["key"], self.records[mine]["hash"], self.records[mine]["status"]) == (source, key, hash_, decision):
            outcome = "unchanged"
        else:
            old = self.records[mine]
            if (old["source"], old["key"]) != (source, key):
                del self.index[old["source"], old["key"]]
                self.seen[mine] = dict.fromkeys(self.seen[mine], "SUPPORTING")
            self.records[mine], outcome = new, "updated"
        self.index[source, key] = mine
        self.seen[mine][source, key] = "PRIMARY"
        return outcome, mine


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_runs_of_one_source_each_are_a_plain_run_s(spark, seed):
    rng = random.Random(seed)
    plain, stored, seen, name = Plain(), spark.createDataFrame([], EMPTY), None, {}
    for batch in range(4):
        source = rng.choice("abcd")
        rows = []
        for n in range(30):
            # the keys of a source say different things, those of several sources the same; some versions are invalid
            k = rng.randrange(6)
            rows.append((source, SOURCES[source], f"{source}{k}" if rng.random() < 0.8 else f"x{k}", f"m{k + 10 * (rng.random() < 0.2)}", rng.choice("gh"), rng.choice(["PUBLISHED", "PUBLISHED", "PENDING_REVIEW", None]), n))
        rows = [r for r in rows if r[2][0] != "x" or r[3] == f"m{r[2][1:]}"]
        rows = [(*r[:2], r[2] if r[2][0] == source else f"{source}{r[2][1:]}", *r[3:]) for r in rows]
        want = {r[6]: plain.take(source, r[2], *r[3:6]) for r in sorted(rows, key=lambda r: (r[2], r[6]))}
        df = P.outcomes(spark.createDataFrame(rows, ROWS), stored if batch else None, seen).cache()
        got = {r.number: (r.outcome, r.owner) for r in df.collect()}
        assert {n: o for n, (o, _) in got.items()} == {n: o for n, (o, _) in want.items()}, (seed, batch)
        for n, (_, record) in want.items():
            assert (record is None) == (got[n][1] is None)
            assert record is None or name.setdefault(record, got[n][1]) == got[n][1]
        stored = spark.createDataFrame(P.merged(stored, df).collect(), EMPTY)
        seen_rows = P.sighted(seen, df, F.lit(AT).cast("timestamp_ntz"))
        seen = spark.createDataFrame(seen_rows.collect(), seen_rows.schema)
        assert {r.content_id: (r.source_id, r.source_key, r.semantic_key, r.content_hash, r.status) for r in stored.collect()} == {name[n]: tuple(r[x] for x in ("source", "key", "meaning", "hash", "status")) for n, r in plain.records.items()}
        assert {(r.content_id, r.source_id, r.source_key): r.role for r in seen.collect()} == {(name[n], *k): role for n, rows in plain.seen.items() for k, role in rows.items()}


def decided(spark, rows, *store):
    df = P.outcomes(spark.createDataFrame([(s, SOURCES[s], k, m, h, d, n) for n, (s, k, m, h, d) in enumerate(rows)], ROWS), *store)
    return df, [r.outcome for r in df.orderBy("number").collect()]


def test_invalid_candidates_change_nothing(spark):
    empty = spark.createDataFrame([], EMPTY)
    df, got = decided(spark, [("a", "k", "m", "h1", "PUBLISHED"), ("a", "k", "m", "h2", None), ("b", "q", "n", "h1", None), ("b", "q", "n", "h2", "PENDING_REVIEW"), ("b", "q", "n", "h2", None)])
    assert got == ["created", "rejected", "rejected", "created", "rejected"]
    assert sorted((r.source_id, r.content_hash, r.status) for r in P.merged(empty, df).collect()) == [("a", "h1", "PUBLISHED"), ("b", "h2", "PENDING_REVIEW")]


def test_versions_of_a_key_in_one_batch(spark):
    published, pending = "PUBLISHED", "PENDING_REVIEW"
    rows = [("a", "k", "m", h, d) for h, d in [("1", pending), ("1", pending), ("2", pending), ("2", published), ("3", pending), ("2", published), ("4", None), ("5", published), ("2", published)]]
    df, got = decided(spark, rows)
    assert got == ["created", "unchanged", "updated", "updated", "review-held", "unchanged", "rejected", "updated", "updated"]
    assert {r.owner for r in df.collect()} == {df.first().owner, None}
    assert [(r.content_hash, r.status) for r in P.merged(spark.createDataFrame([], EMPTY), df).collect()] == [("2", published)]


def test_a_record_is_taken_over_once(spark):
    empty = spark.createDataFrame([], EMPTY)
    first, _ = decided(spark, [("d", "k", "m", "h", "PUBLISHED")])
    stored, seen = P.merged(empty, first), P.sighted(None, first, F.lit(AT).cast("timestamp_ntz"))
    df, got = decided(spark, [("b", "x", "m", "h", "PUBLISHED"), ("c", "y", "m", "h", "PUBLISHED"), ("b", "z", "m", "h", "PUBLISHED"), ("d", "k", "m", "i", "PUBLISHED"), ("d", "k", "m", "j", None), ("a", "w", "m", "h", "PENDING_REVIEW")], stored, seen)
    assert got == ["updated", "duplicate", "created", "duplicate", "rejected", "review-held"]
    record = first.first().owner
    assert [r.owner == record for r in df.orderBy("number").collect()] == [True, True, False, True, False, True]
    assert Counter((r.source_id, r.role) for r in P.sighted(seen, df, F.lit(AT).cast("timestamp_ntz")).where(F.col("content_id") == record).collect()) == {("b", "PRIMARY"): 1, ("c", "SUPPORTING"): 1, ("d", "SUPPORTING"): 1}


def test_odd_candidates(spark):
    assert P.outcomes(spark.createDataFrame([], ROWS)).count() == 0
    rows = [("a", SOURCES["a"], None, None, None, None, None)] * 2 + [("a", SOURCES["a"], "k", None, "h", "PUBLISHED", None)] * 2 + [("b", SOURCES["b"], "l", None, "h", "PUBLISHED", 1)]
    assert Counter(r.outcome for r in P.outcomes(spark.createDataFrame(rows, ROWS)).collect()) == {"rejected": 2, "created": 2, "unchanged": 1}


def test_one_fact_that_most_candidates_announce(spark):
    """Leaders are minima: of a fact that all keys name only the first one is looked at by a task."""
    rows = spark.range(20_000).select(F.lit("a").alias("source_id"), F.lit("OFFICIAL_API").alias("source_type"), F.col("id").cast("string").alias("source_key"), F.lit("m").alias("semantic_key"), F.lit("h").alias("content_hash"), F.lit("PUBLISHED").alias("decision"), F.col("id").alias("number"))
    rows = rows.unionByName(rows.withColumns({"source_id": F.lit("b"), "source_type": F.lit("OFFICIAL_WEB")}))
    df = P.outcomes(rows)
    assert {(r.source_id, r.outcome): r["count"] for r in df.groupBy("source_id", "outcome").count().collect()} == {("a", "created"): 20_000, ("b", "duplicate"): 20_000}
    assert "semantic_key" not in "".join(x for x in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Window" in x)
