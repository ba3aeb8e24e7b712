"""A rate limiter with feedback, over a stream of requests and answers.

For each host, requests wait for their turn: no more than ``limit`` of them start within ``interval``, none sooner than
``apart`` after another, none while the host has asked to be left alone. Answers say until when that is, and what limit the
host sees. All of it is state of the host (``transformWithState``): events wait in it until the watermark has passed them, so
that they are taken in the order of their times however they are cut into batches, and a timer wakes the host for what is due.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import registry as G

GRANTS = "host string, id string, asked_ms long, granted_ms long, server_limit int"
_EVENT = "at long, kind string, id string, until long, server_limit int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Policy:
    limit: int = 1
    interval: timedelta = timedelta(seconds=1)
    apart: timedelta = timedelta(0)

    @property
    def milliseconds(self) -> tuple[int, int]:
        ms = timedelta(milliseconds=1)
        return self.interval // ms, self.apart // ms


def answers(rows: DataFrame) -> DataFrame:
    """Answers (host, id, at, status, and the headers limit, remaining, reset, retry_after as texts) as events of a limiter:
    until when the host wants no requests, and the limit that it names."""
    now = F.unix_millis(F.col("at").cast("timestamp"))
    reset, wait = G.rate_limit_reset(F.col("reset"), F.col("at")), G.retry_after(F.col("retry_after"), F.col("at"))
    spent = F.when(F.trim("remaining").try_cast("double") <= 0, reset)
    told = F.when(F.col("status").isin(429, 503), F.coalesce(now + wait, F.when(F.col("status") == 429, reset)))
    number = F.trim("limit").try_cast("double")
    return rows.select("host", F.lit("answer").alias("kind"), F.col("id").cast("string").alias("id"), "at", F.greatest(spent, told).alias("until"), F.when(number > 0, number.cast("int")).alias("server_limit"))


def requests(rows: DataFrame) -> DataFrame:
    """Requests (host, id, at) as events of a limiter."""
    return rows.select("host", F.lit("request").alias("kind"), F.col("id").cast("string").alias("id"), "at", F.lit(None).cast("long").alias("until"), F.lit(None).cast("int").alias("server_limit"))


class _Limiter(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.limit = policy.limit
        self.interval, self.apart = policy.milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _EVENT)
        self.known = handle.getValueState("known", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.at_ms, r.kind, r.id, r.until, r.server_limit) for r in rows]
        self.events.appendList(new)
        self.handle.registerTimer(min(e[0] for e in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        every = [tuple(e) for e in self.events.get()]
        due, later = sorted((e for e in every if e[0] <= now), key=lambda e: e[:3]), [e for e in every if e[0] > now]
        s = json.loads(self.known.get()[0]) if self.known.exists() else {"starts": [], "blocked": 0, "limit": None, "queue": []}
        granted: list[tuple[str, int, int]] = []

        def settle(before: int) -> None:
            """Grant what may start before an instant."""
            while s["queue"]:
                at = self.turn(s)
                if at >= before:
                    return
                asked, name = s["queue"].pop(0)
                s["starts"] = [*s["starts"], at][-self.limit :]
                granted.append((name, asked, at, s["limit"]))

        for at, kind, name, until, limit in due:
            settle(at)
            if kind == "request":
                s["queue"].append([at, name])
            else:
                s["blocked"] = max(s["blocked"], until or 0)
                s["limit"] = limit if limit is not None else s["limit"]
        settle(now + 1)
        (self.events.put(later) if later else self.events.clear())
        self.known.update((json.dumps(s),))
        turns = [e[0] for e in later] + ([self.turn(s)] if s["queue"] else [])
        if turns:
            self.handle.registerTimer(max(min(turns), now + 1))
        return (Row(host=key[0], id=name, asked_ms=asked, granted_ms=at, server_limit=limit) for name, asked, at, limit in granted)

    def turn(self, s: dict) -> int:
        """When the first that waits may start, as things stand."""
        starts = s["starts"]
        at = max(s["queue"][0][0], s["blocked"])
        if starts:
            at = max(at, starts[-1], starts[-1] + self.apart)
        return max(at, starts[0] + self.interval) if len(starts) >= self.limit else at

    def close(self) -> None:
        pass


def granted(events: DataFrame, policy: Policy, late: str = "0 seconds") -> DataFrame:
    """GRANTS of a stream of events (host, kind, id, at, until, server_limit): when each request may start, as far as the
    watermark, ``late`` behind the latest event, has come. At one instant answers come before requests, both by id; an answer
    holds for what starts at its instant. The session's state store has to be ``PROVIDER``."""
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withColumn("at_ms", F.unix_millis("at"))
    return timed.withWatermark("at", late).groupBy("host").transformWithState(_Limiter(policy), GRANTS, "Append", "EventTime")
