"""Known answers of the reference's own cases, and odd rows, on small hand-made tables."""

from __future__ import annotations

import datetime as dt
import json
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import identity as I
from tidemark.functions import recurrence as R
from tidemark.functions import state as S
from tidemark.functions import text as X
from tidemark.functions import times as T
from tidemark.functions.state import instant
from tidemark.operators import content as C
from tidemark.operators import diff as D
from tidemark.operators import evidence as E
from tidemark.operators import links as L
from tidemark.operators import parse as K
from tidemark.operators import publish as P
from tidemark.operators import registry as G
from tidemark.operators import robots as RB
from tidemark.operators import validate as V
from tidemark.sources import feeds
from tidemark.sources.feeds import candidate
from tidemark.streaming import ingest

NOW = "2026-10-02 03:00:00"


def ts(text):
    return dt.datetime.fromisoformat(text)


def values(spark, rows, make, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(make(*[F.col(c) for c in df.columns])).collect()]


# --- zones and times


def test_fixed_offsets(spark):
    got = values(spark, ["UTC", "utc+8", "UTC +8", "GMT-5", "+09:00", "+0900", "UTC+5:30", "UTC+15", "UTC+5:75", "Asia/Seoul", ""], T.fixed_offset_minutes)
    assert got == [0, 480, 480, -300, 540, 540, 330, None, None, None, None]
    assert values(spark, [0, 540, -210, 330], T.offset_label, "x int") == ["UTC", "UTC+9", "UTC-3:30", "UTC+5:30"]


def test_gaps_and_overlaps(spark):
    """A local time in a gap moves forward by the gap, in an overlap it is the earlier instant, whatever the session's zone."""
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Seoul"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = values(spark, ["2026-03-08 02:30:00", "2026-11-01 01:30:00", "2026-07-01 12:00:00"], lambda x: T.to_instant(x.cast("timestamp_ntz"), "America/New_York"))
            assert got == [ts("2026-03-08 07:30:00"), ts("2026-11-01 05:30:00"), ts("2026-07-01 16:00:00")]
            assert values(spark, ["2026-03-08 07:30:00"], lambda x: T.to_wall(x.cast("timestamp_ntz"), "America/New_York")) == [ts("2026-03-08 03:30:00")]
            assert values(spark, ["2026-10-02T03:00:00Z", "2026-10-02T12:00+09:00", "x"], T.stated_instant) == [ts(NOW), ts(NOW), None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_source_times(spark):
    got = values(spark, ["2026-10-02T12:00:00", "2026/10/02", "2026-10-02T12:00:00+08:00", " ", "9999-12-31T00:00:00", "soon", None], lambda x: T.source_date_time(x, "Asia/Seoul"))
    assert got == [ts("2026-10-02 03:00:00"), ts("2026-10-01 15:00:00"), ts("2026-10-02 04:00:00"), None, None, None, None]
    assert values(spark, ["점검 2026년 9월 30일 (수) 05:00 부터", "2026-02-30 10:00", "none"], T.source_wall_time) == [ts("2026-09-30 05:00:00"), None, None]


def test_relative_times(spark):
    got = values(spark, ["@now", "@+1d2h3m", "@-2h", "@+1d/06:00", "2026-10-02T00:00:00Z", "@later", None], lambda x: T.relative_time(x, S.instant(NOW), "Asia/Seoul"))
    assert got == [ts(NOW), ts("2026-10-03 05:03:00"), ts("2026-10-02 01:00:00"), ts("2026-10-02 21:00:00"), ts("2026-10-02 00:00:00"), None, None]


def test_durations(spark):
    at = lambda x: x.cast("timestamp_ntz")
    times = ["2026-10-02 04:01:01", "2026-10-05 03:00:00", "2026-10-02 02:00:00", "2026-10-02 03:00:00"]
    assert values(spark, times, lambda x: T.remaining(at(x), S.instant(NOW), "Asia/Seoul")) == ["01:01:01", "D-3", None, None]
    assert values(spark, [59, 3600, 360_000], T.clock, "x long") == ["00:00:59", "01:00:00", "100:00:00"]


# --- recurrences


def rule(**k):
    return R.Rule(**{"id": "r", "game_id": "g", "name": "n", "frequency": "CUSTOM_RRULE", "timezone": "Asia/Seoul", "hour": 6, "minute": 0, **k})


def following(spark, r, after):
    rows = R.next_occurrence(R.rules_table(spark, (r,)), S.instant(after)).collect()
    return rows[0].next_at if rows else None


def test_next_occurrences(spark):
    weekly = rule(frequency="WEEKLY", day_of_week=3)
    assert following(spark, weekly, NOW) == ts("2026-10-06 21:00:00")
    assert following(spark, weekly, "2026-10-06 21:00:00") == ts("2026-10-13 21:00:00")  # strictly after
    new_york = rule(frequency="DAILY", timezone="America/New_York", hour=2, minute=30)
    assert following(spark, new_york, "2026-03-08 00:00:00") == ts("2026-03-08 07:30:00")
    assert following(spark, rule(frequency="MONTHLY", day_of_month=-1), NOW) == ts("2026-10-30 21:00:00")
    assert following(spark, rule(rrule="FREQ=MONTHLY;BYDAY=-1FR"), NOW) == ts("2026-10-29 21:00:00")
    # day of the month and weekday unite
    assert following(spark, rule(rrule="FREQ=MONTHLY;BYMONTHDAY=20;BYDAY=1MO"), NOW) == ts("2026-10-04 21:00:00")
    assert following(spark, rule(rrule="FREQ=DAILY;INTERVAL=2;BYHOUR=4,12", anchor=ts("2026-10-01 00:00:00")), NOW) == ts("2026-10-02 19:00:00")
    assert following(spark, rule(rrule="FREQ=DAILY;UNTIL=20261001"), NOW) is None
    assert following(spark, rule(frequency="DAILY", timezone="Mars/Base"), NOW) is None


def test_previous_and_between(spark):
    table = R.rules_table(spark, (rule(frequency="WEEKLY", day_of_week=3),))
    assert R.previous_occurrence(table, S.instant("2026-09-29 21:00:00")).first().previous_at == ts("2026-09-29 21:00:00")
    rows = R.occurrences_between(table, S.instant("2026-09-29 21:00:00"), S.instant("2026-10-13 21:00:00")).orderBy("at").collect()
    assert [r.at for r in rows] == [ts("2026-09-29 21:00:00"), ts("2026-10-06 21:00:00")]


@pytest.mark.parametrize("text", ["FREQ=YEARLY", "FREQ=DAILY;FREQ=DAILY", "FREQ=DAILY;BYDAY=MO", "FREQ=WEEKLY;BYDAY=1MO", "FREQ=DAILY;INTERVAL=0", "FREQ=WEEKLY;BYMONTHDAY=3", "FREQ=DAILY;UNTIL=20260230", "FREQ=DAILY;WKST=SU", "FREQ=DAILY;COUNT=3", ""])
def test_bad_rules(text):
    with pytest.raises(R.RuleError):
        R.parse_rrule(text)
    assert R.problems(rule(rrule=text))


# --- texts and identities


def test_texts(spark):
    html = "<p>Hello &amp; <b>you</b>&#33;</p><script>x()</script><p>a&#x1F600;b &bogus; &lt;i&gt;</p><!-- gone --><br>end"
    assert values(spark, [html], X.html_text) == ["Hello & you !\na😀b &bogus; <i>\nend"]
    assert values(spark, ["a &#65; b", "no entity", "&#xD800; x", "&#99999999; y", None], X.decode_entities) == ["a A b", "no entity", "&#xD800; x", "&#99999999; y", None]
    assert values(spark, ["https://a.example.com/x", "https://example.com.evil.test/", "HTTP://EXAMPLE.COM", "nothing", None], lambda x: X.host_allowed(x, F.array(F.lit("example.com"))))[:4] == [True, False, True, False]


def test_identities(spark):
    assert values(spark, ["", "a", "foobar"], I.fnv1a32) == ["811c9dc5", "e40c292c", "bf9cf968"]
    assert values(spark, ['{"b":1,"a":{"d":[1,{"z":1,"y":null}]}}'], I.canonical_json) == ['{"a":{"d":[1,{"y":null,"z":1}]},"b":1}']
    assert values(spark, ["Crème  Brûlée!", "원신", None], I.slug) == ["creme-brulee", "", None]
    assert values(spark, ["[공지] ＡＢＣ  Title!"], I.title_identity) == ["abctitle"]
    assert values(spark, [("a", None), ("a", "")], I.fingerprint, "x string, y string") == [values(spark, ["a|"], I.fnv1a32)[0]] * 2


# --- parsers and feeds


def test_date_ranges(spark):
    cases = {
        "2026/09/30 10:00 ~ 2026/11/03 03:59 (UTC+8)": (ts("2026-09-30 02:00:00"), ts("2026-11-02 19:59:00"), "UTC+8"),
        "2026년 7월 30일 11:00 ~ 2026년 8월 19일 12:59 (한국 시간)": (ts("2026-07-30 02:00:00"), ts("2026-08-19 03:59:00"), "Asia/Seoul"),
        "점검 시간: 2026년 9월 30일 05:00 ~ 12:00": (ts("2026-09-29 20:00:00"), ts("2026-09-30 03:00:00"), "Asia/Seoul"),
        "2026-09-30 (수) 10:00 (서버 시간) - 2026-10-01 10:00": (ts("2026-09-30 02:00:00"), ts("2026-10-01 02:00:00"), "UTC+8"),
        "2026/09/30 10:00 ~ 2026/11/03 03:59 (somewhere)": (None, None, None),
    }
    for text, want in cases.items():
        got = values(spark, [text], lambda x: K.date_range(x, F.lit("Asia/Seoul"), F.lit("UTC+8")))[0]
        assert (got.start_at, got.end_at, got.zone) == want and got.confidence == (0.9 if want[2] else 0.3), text
    assert values(spark, ["no dates", "2026/13/30 10:00 ~ 2026/11/03 03:59", None, ""], lambda x: K.date_range(x, F.lit("UTC"), F.lit("UTC"))) == [None] * 4


def test_synthetic_and_manual_files(spark, tmp_path):
    feed = {"gameId": "genshin", "timezone": "UTC+8", "locale": "ko-KR", "region": "asia", "documents": [{"externalId": "d1", "url": "https://x.example/1", "publishedAt": "@-1h", "items": [
        {"key": "a", "kind": "EVENT", "title": "t", "startAt": "@-1d/10:00", "endAt": "@+2d", "timing": "auto"}, {"key": "b", "title": "no kind"}, {"key": "c", "kind": "EVENT", "title": "x", "startAt": "@never"}, {"key": "d", "kind": "PATCH", "title": "p", "patch": {"version": "1.2"}, "priority": 90}]}]}
    (tmp_path / "genshin.json").write_text(json.dumps(feed))
    raw = feeds.read_json_files(spark, str(tmp_path / "*.json"))
    got = feeds.synthetic_feed(raw, S.instant(NOW))
    rows = {r.source_key: r for r in got.candidates.collect()}
    assert set(rows) == {"d1#a", "d1#d"} and rows["d1#a"].start_at == ts("2026-10-01 02:00:00") and rows["d1#a"].end_at == ts("2026-10-04 03:00:00")
    assert rows["d1#a"].start_at_source == "2026/10/01 10:00 (UTC+8)" and rows["d1#a"].is_synthetic and rows["d1#a"].source_published_at == ts("2026-10-02 02:00:00")
    assert rows["d1#d"].version == "1.2" and rows["d1#d"].priority == 90 and rows["d1#a"].priority == 50
    assert {(r.position, r.reason) for r in got.rejected.collect()} == {(1, "unexpected shape"), (2, "bad time")}
    manual = {"gameId": "lol", "items": [{"kind": "PATCH", "title": "P", "sourceUrl": "https://x.example", "startAt": "2026-10-02T12:00:00+09:00"}, {"kind": "PATCH", "title": "P"}]}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "lol.json").write_text(json.dumps(manual))
    got = feeds.manual_items(feeds.read_json_files(spark, str(tmp_path / "m")))
    one = got.candidates.collect()[0]
    assert one.source_key.startswith("manual-") and len(one.source_key) == 15 and one.start_at == ts(NOW) and got.rejected.count() == 1


def test_broken_documents_do_not_fail(spark):
    raw = spark.createDataFrame([("a", "not json"), ("b", None), ("c", "[]"), ("event", '{"event_notice":[1]}'), ("d", "[1, {}]")], "document_key string, raw_text string")
    hosts = F.array(F.lit("x.example"))
    for got in (feeds.event_list(raw, hosts), feeds.typed_notices(raw, hosts), feeds.keyed_notices(raw, hosts), feeds.service_status(raw, "p")):
        assert got.candidates.count() == 0
        got.rejected.count()


def test_raw_documents(spark):
    rows = spark.createDataFrame([("https://a/1", None, "body", 200), ("https://a/2", "e2", "old", 304)], "url string, external_id string, raw_text string, http_status int")
    got = {r.document_key: r for r in feeds.raw_documents(rows, "s", S.instant(NOW)).collect()}
    assert got["https://a/1"].raw_text == "body" and not got["https://a/1"].not_modified and got["e2"].raw_text == "" and got["e2"].not_modified


# --- differences, links, registries


def test_directions(spark):
    rows = [([1.0], [2.0]), ([2.0, 2.0], [1.0]), ([1.0, 2.0], [2.0, 1.0]), ([1.0], [1.0])]
    assert values(spark, rows, D.direction, "a array<double>, b array<double>") == ["BUFF", "NERF", "ADJUST", "ADJUST"]
    assert values(spark, rows, lambda a, b: D.direction(a, b, True), "a array<double>, b array<double>") == ["NERF", "BUFF", "ADJUST", "ADJUST"]
    assert values(spark, [([1.0, 1.0],), ([1.0, 2.5],), ([0.33333],)], D.ranks_text, "a array<double>") == ["1", "1/2.5", "0.3333"]


ROBOTS = """\ufeffUser-agent: other
Disallow: /
# a comment
User-agent: me
User-agent: friend # both
Disallow: /c
Disallow:
Allow: /c/open*
Disallow: /*.pdf$

User-agent: *
Disallow: /a
Allow: /a/b
Disallow: /a.b
"""


def robots(spark, agent, paths, status=200, body=ROBOTS):
    files = spark.createDataFrame([("h", status, body)], "host string, status int, body string")
    asked = spark.createDataFrame([("h", p) for p in paths], "host string, path string")
    return {r.path: r.allowed for r in RB.allowed(asked, RB.rules(files), agent).collect()}


def test_robots(spark):
    assert robots(spark, "you", ["/a", "/a/b", "/c", "/axb"]) == {"/a": False, "/a/b": True, "/c": True, "/axb": False}
    assert robots(spark, "Me-Collector/0.1 (+url)", ["/a", "/c", "/c/opened", "/x.pdf", "/x.pdf?y"]) == {"/a": True, "/c": False, "/c/opened": True, "/x.pdf": False, "/x.pdf?y": True}
    assert robots(spark, "friend", ["/c"]) == {"/c": False}
    for status in (None, 429, 500):
        assert robots(spark, "you", ["/"], status, None) == {"/": False}
    assert robots(spark, "you", ["/"], 404, "Disallow: /") == {"/": True} == robots(spark, "you", ["/"], 200, "")
    at = lambda h: datetime(2024, 1, 1, h)
    answers = spark.createDataFrame([("h", 200, "a", at(1)), ("h", 500, None, at(2)), ("g", 200, "b", at(3))], "host string, status int, body string, fetched_at timestamp_ntz")
    assert {r.host: r.status for r in RB.fresh(answers, F.lit(at(8)).cast("timestamp_ntz")).collect()} == {"h": 500, "g": 200}
    assert {r.host for r in RB.fresh(answers, F.lit(at(9)).cast("timestamp_ntz")).collect()} == {"g"}


def test_children_and_entities(spark):
    content = spark.createDataFrame([("1",), ("2",)], "id string")
    kids = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a")], "content_id string, position int, v string")
    got = {r.id: [c.v for c in r.kids] for r in L.with_children(content, kids, "kids").collect()}
    assert got == {"1": ["a", "b"], "2": []}
    names = spark.createDataFrame([("T", "k", "x"), ("T", "k", "y"), ("T", "old", "z")], "type string, key string, name string")
    known = spark.createDataFrame([("T", "old", "id-1")], "type string, key string, entity_id string")
    resolved, new = L.with_entities(names, known)
    assert [(r.key, r.name) for r in new.collect()] == [("k", "y")] and resolved.where("entity_id is null").count() == 0


def test_schedule_refuses_synthetic(spark):
    a = G.adapters_table(spark, (G.Adapter("x", "lol", ("fixture",), "ENABLED"),))
    assert G.schedule(a, "fixture", synthetic_allowed=False).first().reason == "REFUSED_MODE"
    assert G.schedule(a, "fixture").first().every_minutes == 60


# --- streams


CANDIDATES = "source_id string, source_type string, source_key string, number bigint, semantic_key string, content_hash string, decision string"


def test_ingest_is_idempotent(spark, tmp_path):
    rows = [("s1", "OFFICIAL_API", "a", 1, "f1", "h1", "PUBLISHED"), ("s2", "MANUAL", "b", 2, "f1", "h2", "PUBLISHED"), ("s2", "MANUAL", "c", 3, "f2", "h3", "PENDING_REVIEW"), ("s3", "MANUAL", "d", 4, "f3", "h4", None)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, CANDIDATES).coalesce(1).write.parquet(src)
    log = ingest.ContentLog(spark, f"file://{tmp_path}/log")
    stream = lambda: ingest.ingest(ingest.files(spark, src, CANDIDATES), log, str(tmp_path / "state")).awaitTermination()
    stream()
    first = sorted(map(tuple, log.current().collect()))
    assert len(first) == 2
    stream()  # nothing new
    assert sorted(map(tuple, log.current().collect())) == first
    # the same batch again replaces what it wrote
    log.apply(spark.createDataFrame(rows, CANDIDATES), 0)
    assert sorted(map(tuple, log.current().collect())) == first
    # a stronger source takes a fact over, an unchanged one does not
    more = [("s0", "OFFICIAL_API", "z", 5, "f2", "h9", "PUBLISHED"), ("s1", "OFFICIAL_API", "a", 6, "f1", "h1", "PUBLISHED")]
    spark.createDataFrame(more, CANDIDATES).coalesce(1).write.mode("append").parquet(src)
    stream()
    now = {r.semantic_key: r for r in log.current().collect()}
    assert now["f2"].source_id == "s0" and now["f2"].status == "PUBLISHED" and now["f1"].content_hash == "h1" and len(now) == 2


def test_stream_dedup_and_windows(spark, tmp_path):
    schema = "source_id string, document_key string, content_hash string, fetched_at timestamp"
    rows = [("s", "k", "h", ts("2026-10-02 03:00:00")), ("s", "k", "h", ts("2026-10-02 04:00:00")), ("s", "k", "h2", ts("2026-10-02 05:00:00"))]
    src = str(tmp_path / "raw")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    out = str(tmp_path / "out")
    ingest.changed_only(ingest.files(spark, src, schema)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 2
    counted = ingest.windowed_counts(ingest.files(spark, src, schema), "fetched_at", "2 hours", "source_id")
    done = ingest.drained(counted, ["window_start", "source_id"], str(tmp_path / "w"), str(tmp_path / "c2"))
    assert sorted(r.rows for r in done.collect()) == [1, 2]
    sess = ingest.sessions(ingest.files(spark, src, schema), "fetched_at", "90 minutes", "source_id")
    assert sess.isStreaming and "session_start" in sess.columns


def test_titles_without_remarks(spark):
    titles = ["[긴급] ＡＢＣ１２ ｄ", "<x> 〈공지〉 abc 12 D!", "【a】(b)（c）〔d〕「e」Abc12d", "(a remark of more than twenty-four letters) z", "abc12d"]
    assert values(spark, titles, I.title_identity) == ["abc12d", "abc12d", "abc12d", "aremarkofmorethantwentyfourlettersz", "abc12d"]
    assert values(spark, ["Épreuve d’été", "ﬁn", None], I.slug) == ["epreuve-d-ete", "fin", None]
    assert values(spark, ["  Ｕｓｅ  ＣＯＤＥ ", "x"], X.for_match) == ["use code", "x"]


def test_same_source_is_no_twin(spark):
    schema = "source_id string, source_type string, source_key string, semantic_key string, content_hash string, decision string, number int"
    strong, weak = ("a", "OFFICIAL_API"), ("b", "OFFICIAL_WEB")

    def decided(rows, *store):
        got = P.outcomes(spark.createDataFrame([(*s, key, "fact", h, d, i) for i, (s, key, h, d) in enumerate(rows)], schema), *store)
        return got, {(r.source_id, r.source_key): (r.outcome, r.owner) for r in got.collect()}

    one, got = decided([(strong, "k1", "h", "PUBLISHED"), (strong, "k2", "h", "PUBLISHED"), (weak, "k3", "h", "PUBLISHED"), (weak, "k4", "h", None)])
    assert {k: o for k, (o, _) in got.items()} == {("a", "k1"): "created", ("a", "k2"): "created", ("b", "k3"): "duplicate", ("b", "k4"): "rejected"}
    assert got["b", "k3"][1] == got["a", "k1"][1] != got["a", "k2"][1]
    # a weaker owner first, then the stronger source: the record is taken over, and the old owner's candidates are duplicates
    empty = spark.createDataFrame([], "content_id string, " + ", ".join(f"{c} string" for c in P.STORE))
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    one, first = decided([(weak, "k3", "h", "PUBLISHED"), (weak, "k5", "h", "PUBLISHED")])
    assert {o for o, _ in first.values()} == {"created"}
    stored, seen = P.merged(empty, one), P.sighted(None, one, at)
    two, second = decided([(strong, "k1", "x", "PUBLISHED"), (weak, "k3", "h", "PUBLISHED"), (weak, "k5", "y", "PUBLISHED"), (strong, "k2", "x", "PENDING_REVIEW")], stored, seen)
    taken = second["a", "k1"][1]
    assert second["a", "k1"][0] == "updated" and taken in (first["b", "k3"][1], first["b", "k5"][1])
    kept = "k5" if taken == first["b", "k3"][1] else "k3"
    assert second["b", "k3" if kept == "k5" else "k5"] == ("duplicate", taken) and second["b", kept][0] == ("updated" if kept == "k5" else "unchanged")
    assert second["a", "k2"][0] == "created"
    stored, seen = P.merged(stored, two), P.sighted(seen, two, at)
    assert {(r.source_id, r.role) for r in seen.where(F.col("content_id") == taken).collect()} == {("a", "PRIMARY"), ("b", "SUPPORTING")}
    # what the weak source reported before is found through provenance, by another meaning too
    _, third = decided([(weak, "k3" if kept == "k5" else "k5", "z", "PUBLISHED")], stored.withColumn("semantic_key", F.lit("other")), seen)
    assert set(third.values()) == {("duplicate", taken)}


def test_shape_timing_and_evidence(spark):
    good = dict(kind="EVENT", game_id="lol", source_key="k", title="t", source_url="https://x.example/1", priority=50, confidence=1.0, is_synthetic=False)

    def issues(excerpts=(), parser="deterministic", document=None, **more):
        c = candidate(**{**good, **more})
        of = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(x).alias("excerpt")) for f, x in excerpts]).cast("array<struct<field:string,excerpt:string>>")
        rows = spark.range(1).select(F.explode(V.candidate_issues(c, of, F.lit(parser), F.lit(document).cast("string"), F.lit("lol"), F.lit("OFFICIAL_API"), F.array(F.lit("EVENT"), F.lit("REDEEM_CODE")), F.array(F.lit("x.example")), instant("2024-01-01 00:00:00"))).alias("i")).select("i.*")
        return [(r.code, r.field) for r in rows.collect()]

    end = instant("2024-02-01 00:00:00")
    assert issues(end_at=end) == []
    assert issues(kind="NONE", title=" ", priority=101, source_url="x") == [("SCHEMA", f) for f in ("kind", "title", "source_url", "priority")]
    assert issues(kind="PATCH") == [("SCHEMA", "version")] and issues(kind="REDEEM_CODE", code="a b") == [("SCHEMA", "code")]
    start = instant("2024-01-10 01:00:00")
    assert issues(start_at=start, end_at=end, source_timezone="Asia/Seoul", start_at_source="2024년 1월 10일 (수) 10:00") == []
    assert issues(start_at=start, end_at=end, source_timezone="Asia/Seoul", start_at_source="2024/01/10 11:00", end_at_source="2024-02-01T08:00") == [("TIMEZONE_MISMATCH", "startAt"), ("TIMEZONE_MISMATCH", "endAt")]
    assert issues(start_at=start, end_at=end, source_timezone="Asia/Seoul", precision="DATE", start_at_source="2024/01/10 11:00") == []
    assert issues(end_at=end, source_timezone="Mars/Base") == [("TIMEZONE_UNKNOWN", "timing.sourceTimezone")]
    ai = dict(parser="ai", end_at=end, document="Ｅｎｄｓ on\n 1 February")
    assert issues([("endAt", "ends on 1 february")], **ai) == [] and issues([], **ai) == [("AI_WITHOUT_EVIDENCE", None)]
    assert issues([("title", "x")], **ai) == [("AI_FIELD_WITHOUT_EVIDENCE", "endAt"), ("EVIDENCE_NOT_IN_SOURCE", "title")]
    assert issues([], kind="REDEEM_CODE", code="CODE1", end_at=end) == [("CODE_WITHOUT_EVIDENCE", "redeemCode.code")]
    assert issues([("redeemCode.code", "Use code1 now")], kind="REDEEM_CODE", code="CODE1", end_at=end) == []


def test_inactive_rules_give_nothing(spark):
    rules = R.rules_table(spark, (R.Rule("on", "lol", "x", "DAILY", "UTC", 1, 0), R.Rule("off", "lol", "x", "DAILY", "UTC", 1, 0, is_active=False), R.Rule("over", "lol", "x", "CUSTOM_RRULE", "UTC", 1, 0, rrule="FREQ=DAILY;UNTIL=20230101T000000Z")))
    now = instant("2024-01-01 00:00:00")
    assert [r.id for r in R.next_occurrence(rules, now).collect()] == ["on"] == [r.id for r in R.previous_occurrence(rules, now).collect()]
    assert [r.id for r in R.without_future(rules, now).collect()] == ["over"]
    assert [r.id for r in R.listed(rules).collect()] == ["on", "over"] and R.listed(rules, ()).count() == 0


def test_evidence_finds_every_passage(spark):
    texts = ['He said: "The quick brown fox, (jumps) over it all today', "prefix ab suffix", "xquick brownish", "ＦＵＬＬ width  text", "", None]
    asked = ["the quick brown fox, (jumps) over it", "quick brown", "ab", "k b", "full width text", "e fox", "o", "brown fox, (jumps) over it all tod", "nothing like it in here at all", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    items = spark.createDataFrame(list(enumerate(asked)), "item_id int, text string")
    norm = lambda t: " ".join(unicodedata.normalize("NFKC", t or "").lower().split())
    want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(asked) if norm(p) and norm(p) in norm(t)}
    assert {(r.doc_id, r.item_id) for r in E.containing(docs, items).collect()} == want
