"""Registered queries: the operators over the driver's tables. ``oracles.py`` has the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session
from ..functions import identity as I
from ..functions import model as M
from ..functions import recurrence as R
from ..functions import state as S
from ..functions import text as X
from ..functions import times as T
from ..operators import content as C
from ..operators import diff as D
from ..operators import evidence as E
from ..operators import publish as P
from ..operators import validate as V
from . import driver_views as D7
from . import views
from .driver_views import now

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def content_window_query(spark: SparkSession, sf: str) -> DataFrame:
    """Published, real items of two games whose time touches a closed window."""
    window = (S.instant("2024-01-10 00:00:00"), S.instant("2024-01-20 00:00:00"))
    q = C.ContentQuery(game_ids=("lol", "genshin"), window=window, include_synthetic=False)
    return D7.items(spark, sf).where(C.matches(q)).select("id", "game_id", "type", "title", "start_at", "end_at", S.effective().alias("effective_at"))


@query
def content_recent(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 most recent items: a top-k report."""
    return C.run(D7.items(spark, sf), C.ContentQuery(limit=50)).select("id", "type", S.effective().alias("effective_at"))


@query
def time_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = D7.items(spark, sf).select("game_id", "type", S.type_status(now()).alias("time_status"))
    return rows.groupBy("game_id", "type", "time_status").agg(F.count("*").alias("items"))


@query
def reward_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    state = S.reward_state(S.time_status(now()))
    rows = D7.published(spark, sf).where(S.is_type("REWARD", "REDEEM_CODE")).select("game_id", state.alias("state"), S.claimable(state).alias("claimable"))
    return rows.groupBy("game_id", "state", "claimable").agg(F.count("*").alias("items"))


@query
def maintenance_state_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = D7.published(spark, sf).where(S.is_type("MAINTENANCE")).select("game_id", S.maintenance_state(now()).alias("state"))
    return rows.groupBy("game_id", "state").agg(F.count("*").alias("items"))


@query
def item_urgency(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_states(D7.published(spark, sf), now()).withColumn("u", S.urgency(now())).select("id", "u.tier", "u.reason", F.col("u.at").alias("moment"))


@query
def today_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry of the digest: items and resets."""
    return views.today(D7.published(spark, sf), R.rules_table(spark), now()).select("section", "kind", "id", "game_id", "tier", "reason", F.col("at").alias("moment"), "priority")


@query
def today_places(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 entries of each section, most urgent first."""
    return views.placed(views.today(D7.published(spark, sf), R.rules_table(spark), now()), 20).select("section", "place", "id")


@query
def today_summary(spark: SparkSession, sf: str) -> DataFrame:
    return views.today_summary(views.today(D7.published(spark, sf), R.rules_table(spark), now()))


@query
def timeline_groups(spark: SparkSession, sf: str) -> DataFrame:
    return views.timeline(D7.published(spark, sf), now(), by=("game_id",)).select("timeline", "game_id", "place", "id")


@query
def pulse_stream(spark: SparkSession, sf: str) -> DataFrame:
    return views.pulse(D7.published(spark, sf), R.rules_table(spark), now()).select("id", "kind", F.col("at").alias("moment"), "game_id", "is_future")


@query
def pulse_places(spark: SparkSession, sf: str) -> DataFrame:
    """The stream of moments in its order, as places."""
    return views.pulse_placed(views.pulse(D7.published(spark, sf), R.rules_table(spark), now())).select("id", "place")


@query
def calendar_places(spark: SparkSession, sf: str) -> DataFrame:
    """A month's entries in their order, as places."""
    month = (S.instant("2024-01-01 00:00:00"), S.instant("2024-02-01 00:00:00"))
    return views.calendar_placed(views.calendar_entries(D7.published(spark, sf), R.rules_table(spark), *month)).select("id", "place")


@query
def section_places(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every entry in its section, most urgent first."""
    return views.placed(views.today(D7.published(spark, sf), R.rules_table(spark), now())).select("section", "place", "id")


@query
def game_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    facts = views.snapshot(D7.published(spark, sf), now())
    return facts.join(F.broadcast(views.reset_facts(R.rules_table(spark), now())), "game_id", "left")


@query
def dashboard_items(spark: SparkSession, sf: str) -> DataFrame:
    return C.dashboard(D7.published(spark, sf), now()).select("id", "game_id", "type")


@query
def calendar_month(spark: SparkSession, sf: str) -> DataFrame:
    entries = views.calendar_month(spark, D7.published(spark, sf), R.rules_table(spark), 2024, 1, now())
    return views.calendar_counts(entries)


@query
def reset_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.occurrences_between(D7.reset_rules(spark, sf), S.instant("2024-01-01 00:00:00"), S.instant("2024-03-01 00:00:00"))
    return rows.select(F.col("id").alias("rule_id"), "game_id", F.col("at").alias("moment"))


@query
def next_reset(spark: SparkSession, sf: str) -> DataFrame:
    return R.next_occurrence(D7.reset_rules(spark, sf), now()).select(F.col("id").alias("rule_id"), "game_id", "next_at")


@query
def patch_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Direction and text of every change of every patch."""
    rows = D7.price_lines(spark, sf)
    return rows.select("patch_id", "position", "target_type", D.direction(F.array("before"), F.array("after"), True).alias("change"), "before", "after")


@query
def change_groups(spark: SparkSession, sf: str) -> DataFrame:
    return D.groups_in_order(D7.price_lines(spark, sf), "patch_id", "target_type", "position")


@query
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    previous, current = D7.part_snapshots(spark, sf)
    return D.entities(previous, current, "p_partkey", {"p_retailprice": True, "p_size": False}, "p_name")


@query
def raw_change_detection(spark: SparkSession, sf: str) -> DataFrame:
    raw = C.changes_of_raw(D7.raw_documents(spark, sf).drop("raw_text"))
    return raw.select("source_id", "document_key", "fetched_at", "content_hash", "change")


@query
def latest_raw_document(spark: SparkSession, sf: str) -> DataFrame:
    return C.latest_version(D7.raw_documents(spark, sf).drop("raw_text")).select("source_id", "document_key", "content_hash", "fetched_at")


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates with all their issues."""
    kinds = F.array(*[F.lit(k) for k in M.CONTENT_TYPES if k != "BANNER"])
    hosts = F.array(*[F.lit(h) for h in D7.HOSTS])
    rows = D7.checked_candidates(spark, sf)
    issues = V.candidate_issues(F.col("c"), F.col("excerpts"), F.col("parser"), F.col("document"), F.col("source_game"), F.col("source_type"), kinds, hosts, now())
    # out of a generator, so that the long expression stands once
    return rows.select("*", F.explode(F.array(F.struct(issues.alias("issues")))).alias("v")).select("c", "source_id", "source_type", "number", "parser", "v.issues")


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    """Validated candidates with what publication asks for: key, hash and decision."""
    c = F.col("c")
    rows = _validated(spark, sf).withColumn("status", V.worst(F.col("issues")))
    key = I.semantic_key(c["game_id"], c["kind"], c["title"], c["start_at"], c["version"], c["code"])
    said = P.content_hash(*[c[f] for f in ("kind", "game_id", "title", "start_at", "end_at", "version", "code", "priority")])
    decision = S.publication(F.col("status"), F.col("source_type"), F.col("parser"))["status"]
    return rows.select("source_id", "source_type", c["source_key"].alias("source_key"), "number", key.alias("semantic_key"), said.alias("content_hash"), decision.alias("decision"), c["start_at"].alias("seen_at"), F.col("status").alias("validation"))


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of the time before now, and those after or without a time."""
    rows = session.written(_decided(spark, sf), "decided")
    early = F.coalesce(F.col("seen_at") < now(), F.lit(False))
    return rows.where(early), rows.where(~early)


def _after_first(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store and provenance after a first batch."""
    done = session.written(P.outcomes(first), "outcomes")
    empty = first.sparkSession.createDataFrame([], "content_id string, " + ", ".join(f"{c} string" for c in P.STORE))
    return session.written(P.merged(empty, done), "stored"), session.written(P.sighted(None, done, now()), "reported")


@query
def candidate_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Every issue of every candidate: form, source, dates, local times, markings, evidence."""
    return _validated(spark, sf).select("number", F.explode("issues").alias("i")).select("number", "i.code", "i.severity", "i.field")


@query
def publish_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of all candidates in one batch, into an empty store."""
    return P.outcomes(_decided(spark, sf)).select("source_id", "source_key", "number", "outcome", "owner")


@query
def publish_second_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A second batch into the store that a first has filled."""
    first, second = _batches(spark, sf)
    return P.outcomes(second, *_after_first(first)).select("source_id", "source_key", "number", "outcome", "owner")


@query
def store_after_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Records and sightings after both batches, by owner and role."""
    first, second = _batches(spark, sf)
    stored, reported = _after_first(first)
    done = session.written(P.outcomes(second, stored, reported), "outcomes")
    records = P.merged(stored, done).groupBy("source_id", "status").agg(F.count("*").alias("rows"))
    sightings = P.sighted(reported, done, now()).groupBy("source_id", F.col("role").alias("status")).agg(F.count("*").alias("rows"))
    return records.select(F.lit("record").alias("of"), "*").unionByName(sightings.select(F.lit("sighting").alias("of"), "*"))


@query
def authority_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest owner of each fact, and how many candidates name it."""
    rows = _decided(spark, sf).where("decision is not null")
    best = F.min_by(F.struct("source_id", "source_key"), F.struct(M.authority(F.col("source_type")), "source_id", "source_key", "number"))
    return rows.groupBy("semantic_key").agg(best.alias("b"), F.count("*").alias("candidates")).select("semantic_key", "b.source_id", "b.source_key", "candidates")


@query
def provenance_rollup(spark: SparkSession, sf: str) -> DataFrame:
    i = D7.candidates(spark, sf).select(F.concat_ws(":", "game_id", "kind", "title").alias("content_id"), "source_id", "source_key", F.col("start_at").alias("seen_at"), M.authority(F.col("source_type")).alias("authority"))
    return P.provenance(i).select("content_id", "source_id", "source_key", "first_seen", "last_seen", "sightings", "role")


@query
def ttl_expiry(spark: SparkSession, sf: str) -> DataFrame:
    """Rows beyond the time to live of their source."""
    rows = D7.candidates(spark, sf).select("number", "source_id", F.col("start_at").alias("last_seen"))
    return P.expired(rows, {"src-1": 3, "src-3": 7, "src-5": 14}, now()).select("number", "source_id")


@query
def raw_text_retention(spark: SparkSession, sf: str) -> DataFrame:
    """How many texts of each source stay and go at a cutoff."""
    raw = D7.raw_documents(spark, sf).select("source_id", "fetched_at", "raw_text")
    kept = P.pruned(raw, S.instant("2024-01-20 00:00:00"))
    return kept.groupBy("source_id").agg(F.count("raw_text").alias("kept"), F.count_if(F.col("raw_text").isNull()).alias("pruned"))


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    c = D7.candidates(spark, sf)
    e = F.col("number")
    hosts = F.array(F.lit("example.com"), F.lit("news.example.org"))
    url = F.concat(F.col("scheme"), F.lit("//"), F.when(e % 4 == 0, "www.example.com").when(e % 4 == 1, "news.example.org").when(e % 4 == 2, "example.com.evil.test").otherwise("example.com"), F.lit("/n/"), e.cast("string"))
    kinds = F.array(*[F.lit(k) for k in ("PATCH", "EVENT", "REWARD", "MAINTENANCE")])
    code = F.when(F.col("kind") == "REDEEM_CODE", F.when(e % 2 == 0, F.concat(F.lit("gptest-"), e.cast("string"))).otherwise(F.concat(F.lit("CODE"), e.cast("string"))))
    end = F.when(e % 7 != 0, F.col("end_at") + F.make_dt_interval((F.when(e % 17 == 0, 400).otherwise(0)).cast("int")))
    start = F.when(e % 13 != 0, F.col("start_at") + F.make_dt_interval((F.when(e % 19 == 0, 800).otherwise(0)).cast("int")))
    items = F.array(F.struct((F.col("value") * F.when(e % 23 == 0, 1e9).otherwise(1)).alias("quantity")))
    every = F.concat(
        V.source(F.col("game_id"), F.when(e % 29 == 0, "lol").otherwise(F.col("game_id")), F.col("kind"), kinds, url, hosts),
        V.dates(F.col("kind"), start, end, now()),
        V.quantities(items),
        V.synthetic(F.col("source_type"), F.col("is_synthetic"), code),
    )
    return c.select("number", "source_type", every.alias("issues"))


@query
def validation_issues(spark: SparkSession, sf: str) -> DataFrame:
    return _issues(spark, sf).select("number", F.explode("issues").alias("i")).select("number", "i.code", "i.severity", "i.field")


@query
def validation_worst_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = _issues(spark, sf).select("source_type", V.worst(F.col("issues")).alias("status"))
    return rows.groupBy("source_type", "status").agg(F.count("*").alias("candidates"))


@query
def publication_decision(spark: SparkSession, sf: str) -> DataFrame:
    parser = F.element_at(F.array(*[F.lit(p) for p in ("deterministic", "ai", "manual", "fixture")]), (F.col("number") % 4 + 1).cast("int"))
    rows = _issues(spark, sf).select("number", S.publication(V.worst(F.col("issues")), F.col("source_type"), parser).alias("p"))
    return rows.select("number", "p.status", "p.verification")


@query
def patch_change_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of the changes of all patches, counted by code."""
    line = D7.read(spark, sf, "lineitem")
    k = F.col("l_partkey")
    before = F.when(k % 5 != 0, F.col("l_quantity").cast("int").cast("string"))
    after = F.when(k % 7 != 0, (F.col("l_quantity").cast("int") + k % 2).cast("string"))
    change = F.when(k % 11 == 0, "NEW").otherwise("ADJUST")
    issues = V.patch_change(change, F.when(k % 3 == 0, "field"), before, after, F.when(k % 2 == 0, "text"))
    rows = line.select("l_returnflag", F.explode(issues).alias("i"))
    return rows.groupBy("l_returnflag", "i.code").agg(F.count("*").alias("issues"))


@query
def host_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    hosts = F.array(F.lit("example.net"), F.lit("example.org"))
    return D7.read(spark, sf, "pages").select("page_id", X.host(F.col("url")).alias("host"), X.host_allowed(F.col("url"), hosts).alias("allowed"))


@query
def page_text(spark: SparkSession, sf: str) -> DataFrame:
    """Readable text of every page."""
    text = X.html_text(F.col("html"))
    return D7.read(spark, sf, "pages").select("page_id", text.alias("text"), F.length(text).alias("n_chars"), X.truncated(X.single_line(text), 160).alias("summary"))


@query
def title_identity(spark: SparkSession, sf: str) -> DataFrame:
    return D7.items(spark, sf).select("id", I.title_identity(F.col("title")).alias("identity"), I.slug(F.col("title")).alias("slug"))


@query
def semantic_keys(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    version, code = F.when(F.col("type") == "PATCH", F.concat(F.lit(" 1."), F.col("id"))), F.when(F.col("type") == "REDEEM_CODE", F.concat(F.lit("code-"), F.col("id")))
    key = I.semantic_key(F.col("game_id"), F.col("type"), F.col("title"), F.col("start_at"), F.coalesce(version, none), F.coalesce(code, none))
    return D7.items(spark, sf).select("id", key.alias("semantic_key"))


@query
def content_ids(spark: SparkSession, sf: str) -> DataFrame:
    return D7.items(spark, sf).select("id", I.content_id(F.col("source_type"), F.col("source_key")).alias("content_id"), I.fnv1a32(F.col("title")).alias("fnv"))


@query
def slug_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Unique slugs of all titles: the first of each keeps it, the others get a suffix."""
    rows = D7.items(spark, sf).select("id", I.slug(F.concat_ws(" ", "game_id", "type", "title"), 110).alias("slug"))
    return P.unique_slugs(rows)


@query
def registry_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a registry sync between two versions of the parts."""
    previous, current = D7.part_snapshots(spark, sf)
    value = F.to_json(F.struct("p_name", "p_retailprice", "p_size"))
    actions = P.sync(previous.select("p_partkey", value.alias("v")), current.select("p_partkey", value.alias("v")), "p_partkey", "v")
    return actions.groupBy("action").agg(F.count("*").alias("parts"))


@query
def evidence_in_source(spark: SparkSession, sf: str) -> DataFrame:
    """Which documents hold which benchmark passages word for word."""
    return E.containing(D7.read(spark, sf, "documents"), D7.read(spark, sf, "benchmark"))


@query
def durations_and_labels(spark: SparkSession, sf: str) -> DataFrame:
    zone = "Asia/Seoul"
    at = F.col("published_at")
    return D7.items(spark, sf).select("id", T.clock(T.seconds_between(now(), at)).alias("clock"), T.d_day(at, now(), zone).alias("d_day"), T.remaining(at, now(), zone).alias("remaining"), T.relative_past(at, now()).alias("ago"), T.weekday_label(T.local_date(at, zone), "en-US").alias("weekday"), T.utc_day(F.col("start_at")).alias("utc_day"))


@query
def last_updated(spark: SparkSession, sf: str) -> DataFrame:
    return D7.published(spark, sf).groupBy("game_id").agg(F.max("updated_at").alias("last_updated_at"))


@query
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of an ingestion run per source: what was found, its validation, its outcomes, and the run's status."""
    rows = P.outcomes(_decided(spark, sf))
    counted = rows.groupBy("source_id").agg(*P.counters(rows))
    return counted.withColumn("run_status", P.run_status(F.col("rejected"), F.col("created") + F.col("duplicate")))


@query
def home_highlights(spark: SparkSession, sf: str) -> DataFrame:
    return views.home(views.today(D7.published(spark, sf), R.rules_table(spark), now())).select("section", "place", "id")
