"""Registered queries over feeds, links, registries and streams. ``feed_oracles.py`` has the same results as SQL."""

from __future__ import annotations

from datetime import timedelta

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
from ..operators import details as DT
from ..operators import diff as D
from ..operators import intervals as V
from ..operators import links as L
from ..operators import parse as K
from ..operators import publish as P
from ..operators import registry as G
from ..operators import robots as RB
from ..operators import runs as RN
from ..operators import shapes as SH
from ..sources import feeds
from ..sources.adapter import ManualFiles
from ..streaming import ingest, limiter
from . import driver_views as D7
from . import feed_views as FV
from . import views
from .driver_views import now, read
from .queries import _batches, query

_SHOWN = ("kind", "source_key", "slug_hint", "title", "start_at", "end_at", "source_url", "source_published_at", "priority", "maintenance_type", "related_source_key")


@query
def feed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of event lists: events, and rewards with a deadline."""
    return feeds.event_list(FV.event_lists(spark, sf), FV.hosts()).candidates.select(*_SHOWN)


@query
def feed_notices(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.typed_notices(FV.notice_lists(spark, sf), FV.hosts()).candidates.select(*_SHOWN)


@query
def feed_keyed_notices(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.keyed_notices(FV.keyed_lists(spark, sf), FV.hosts()).candidates.select(*_SHOWN)


@query
def feed_status(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.service_status(FV.status_documents(spark, sf), "https://status.example.com").candidates.select(*_SHOWN, "summary")


@query
def feed_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Why items of the four feeds were left out."""
    of = {
        "events": feeds.event_list(FV.event_lists(spark, sf), FV.hosts()),
        "notices": feeds.typed_notices(FV.notice_lists(spark, sf), FV.hosts()),
        "keyed": feeds.keyed_notices(FV.keyed_lists(spark, sf), FV.hosts()),
        "status": feeds.service_status(FV.status_documents(spark, sf), "https://status.example.com"),
    }
    rows = None
    for name, n in of.items():
        one = n.rejected.select(F.lit(name).alias("feed"), "reason")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("feed", "reason").agg(F.count("*").alias("items"))


@query
def manual_files(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of operators' files: each customer's orders are a file, in which now and then an item is bad."""
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    item = F.to_json(F.struct(
        F.when(k % 11 != 0, "EVENT").alias("kind"), F.concat(F.lit("order "), k.cast("string")).alias("title"), F.when(k % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")).alias("startAt"),
        F.lit("https://example.com/x").alias("sourceUrl"), F.when(k % 2 == 0, (k % 100).cast("int")).alias("priority"), F.when(k % 3 == 0, F.concat(F.lit("key-"), k.cast("string"))).alias("sourceKey"), (k % 5 == 0).alias("isSynthetic"),
    ))
    files = o.groupBy(F.col("o_custkey").alias("c")).agg(F.collect_list(item).alias("items"))
    raw = files.select(F.col("c").cast("string").alias("document_key"), F.when(F.col("c") % 17 == 0, "wuwa").otherwise("lol").alias("asked_game"), F.to_json(F.struct(F.lit("lol").alias("gameId"), F.lit("n").alias("note"), "items")).alias("raw_text"))
    done = feeds.manual_items(raw, asked=F.col("asked_game"))
    return done.candidates.select("game_id", F.regexp_replace("source_key", "^manual-[0-9a-f]{8}$", "manual").alias("source_key"), "title", "start_at", "priority", "is_synthetic")


@query
def adapter_files(spark: SparkSession, sf: str) -> DataFrame:
    """What a stream of operators' files, read by their data source, gives of each file: its items, or why it is refused."""
    k, staged, out, state = F.floor(F.col("o_orderkey") / 150), *(session.scratch(spark, f"adapter-{n}") for n in ("in", "out", "state"))
    files = read(spark, sf, "orders").groupBy(k.alias("file")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("title"))).alias("items"))
    game = F.when(F.col("file") % 17 == 0, "wuwa").otherwise("lol")
    files.select("file", F.to_json(F.struct(game.alias("gameId"), "items")).alias("value")).write.partitionBy("file").mode("overwrite").text(staged)
    spark.dataSource.register(ManualFiles)
    rows = spark.readStream.format("manual_files").option("game", "lol").load(staged)
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    file = F.regexp_extract("document_key", "file=([0-9]+)/", 1).cast("long")
    return spark.read.parquet(f"{out}/rows").groupBy(file.alias("file")).agg(F.count("item").alias("items"), F.max("reason").alias("reason"))


@query
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user: events not more than six hours apart."""
    rows = read(spark, sf, "events").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("at"))
    found = ingest.sessions(rows, "at", "6 hours", "user_id")
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "rows")


@query
def changed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """How many versions of each source's documents a stream of fetches lets through: those that have not come before."""
    staged, state, out = (session.scratch(spark, f"changed-{n}") for n in ("in", "state", "out"))
    D7.raw_documents(spark, sf).drop("raw_text").withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).write.parquet(f"{staged}/part=0")
    fetched = ingest.files(spark, f"{staged}/*", spark.read.parquet(f"{staged}/part=0").schema, per_batch=1_000_000)
    ingest.changed_only(fetched, horizon="60 days").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("source_id").agg(F.count("*").alias("versions"), F.countDistinct("document_key").alias("documents"))


@query
def item_words(spark: SparkSession, sf: str) -> DataFrame:
    """Slugs of records, when they are over, their zone in words, the worse of two statuses and days that are real."""
    n, i = F.col("number"), D7.items(spark, sf)
    status = lambda c: F.element_at(F.array(*[F.lit(v) for v in M.VALIDATION_STATUSES]), (c % 4 + 1).cast("int"))
    slug = I.content_slug(F.col("game_id"), F.col("type"), F.when(n % 3 != 0, F.concat(F.lit("v 1."), n.cast("string"))), F.when(n % 2 == 0, F.col("title")), F.col("source_key"))
    zone = T.zone_label(F.when(n % 3 == 0, "Asia/Seoul").when(n % 3 == 1, "UTC+8").otherwise("America/New_York"), F.col("published_at"))
    day = T.strict_date(F.concat(F.lit("2024-02-"), F.lpad((n % 32).cast("string"), 2, "0"), F.when(n % 7 == 0, " ").otherwise("")))
    return i.select("id", slug.alias("slug"), S.closed_at().alias("closed_at"), zone.alias("zone"), S.worst_status(status(n), status(F.floor(n / 4))).alias("worst"), day.alias("day"))


@query
def date_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Date ranges out of notices' texts."""
    rows = K.extracted(FV.range_notices(spark, sf))
    return rows.select("number", "kind", "range.start_at", "range.end_at", "range.zone", "range.start_at_source", "range.confidence")


@query
def extraction_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted items of documents with one and with several items as candidates."""
    e = F.col("event_id")
    none = lambda t: F.lit(None).cast(t)
    item = lambda kind, code, version: F.struct(kind.alias("kind"), F.col("event_type").alias("title"), none("string").alias("summary"), F.col("ts").alias("start_at"), none("timestamp_ntz").alias("end_at"), F.when(e % 2 == 0, "stated").alias("start_at_source"), none("string").alias("end_at_source"), none("string").alias("source_timezone"), none("string").alias("precision"), none("string").alias("maintenance_type"), code.alias("code"), version.alias("version"), F.lit(0.5).alias("confidence"))
    first = item(F.when(e % 3 == 0, "PATCH").when(e % 3 == 1, "REDEEM_CODE").otherwise("MAINTENANCE"), F.when(e % 5 != 0, F.concat(F.lit("C"), e.cast("string"))), F.when(e % 4 != 0, e.cast("string")))
    second = item(F.lit("EVENT"), none("string"), none("string"))
    docs = read(spark, sf, "events").select(e.cast("string").alias("document_key"), F.lit("lol").alias("game_id"), F.lit("https://x.example/").alias("source_url"), F.lit("ko-KR").alias("source_locale"), none("timestamp_ntz").alias("source_published_at"), F.lit("kr").alias("region"), F.when(e % 7 == 0, F.array(first, second)).otherwise(F.array(first)).alias("items"))
    return K.extraction_candidates(docs).candidates.select("kind", "source_key", "title", "start_at", "precision", "region", "code", "version", "maintenance_type")


@query
def parse_cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Notices that still have to be parsed: half of them have a result, a few of those a failed one."""
    texts = FV.range_notices(spark, sf).withColumn("input_hash", K.input_hash(F.col("text"), F.col("task")))
    known = texts.where("number % 2 = 0").select("input_hash", F.lit(K.PARSER[0]).alias("parser_id"), F.lit(K.PARSER[1]).alias("parser_version"), F.when(F.col("number") % 10 == 0, "FAILED").otherwise("OK").alias("status"))
    return K.unparsed(texts, known).groupBy("task").agg(F.count("*").alias("texts"))


@query
def champion_diff(spark: SparkSession, sf: str) -> DataFrame:
    previous, current = FV.champion_tables(spark, sf)
    return D.champion_changes(previous, current).select("target_key", "change", "field", "before", "after", "unit")


@query
def item_diff(spark: SparkSession, sf: str) -> DataFrame:
    previous, current = FV.item_tables(spark, sf)
    return D.item_changes(previous, current).select("target_key", "change", "field", "before", "after")


@query
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    champions, items = D.champion_changes(*FV.champion_tables(spark, sf)), D.item_changes(*FV.item_tables(spark, sf))
    return D.diff_summary(champions.unionByName(items))


@query
def related_links(spark: SparkSession, sf: str) -> DataFrame:
    """Rewards linked to the published record of the same source that they name."""
    i = D7.items(spark, sf).withColumn("source_id", F.concat(F.lit("src-"), F.col("authority").cast("string")))
    rows = i.withColumn("related_source_key", F.when(S.is_type("REWARD"), (F.col("number") - 6).cast("string")))
    return L.related(rows.where("related_source_key is not null or type <> 'REWARD'")).where("related_id is not null")


@query
def patch_children(spark: SparkSession, sf: str) -> DataFrame:
    """Patches with their changes in order: number, first and last."""
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("content_id"), F.col("l_linenumber").alias("position"), "l_partkey", "l_suppkey")
    full = L.with_children(orders, lines, "changes")
    return full.select("id", "o_orderstatus", F.size("changes").alias("n_changes"), F.get("changes", F.lit(0))["l_partkey"].alias("first_part"), F.element_at(F.when(F.size("changes") > 0, F.col("changes")), -1)["l_partkey"].alias("last_part"))


def detail_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Records, and the tables of their details and children: line items are what their order's record consists of. Every
    seventeenth record has lost its detail."""
    i = D7.items(spark, sf).withColumns({"source_id": F.concat(F.lit("src-"), F.col("authority").cast("string")), "slug": F.concat_ws("-", F.lower("type"), "id")})
    n, kept = F.col("number"), i.where("number % 17 <> 0").withColumn("content_id", F.col("id"))
    of = lambda kind: kept.where(F.col("type") == kind)
    line = read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("content_id"), F.col("l_linenumber").cast("int").alias("position"), "*")
    part = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    text = lambda c: F.col(c).cast("string")
    tables = {
        "patch": of("PATCH").select("content_id", F.concat(F.lit("1."), text("number")).alias("version"), F.col("start_at").alias("release_at")),
        "event": of("EVENT").select("content_id", F.when(n % 3 == 0, "LOGIN").alias("event_type"), F.when(n % 4 == 2, "all").alias("eligibility"), F.col("title").alias("reward_summary")),
        "reward": of("REWARD").select("content_id", F.lit("LOGIN").alias("reward_type"), F.when(n % 3 == 0, "mail").alias("how_to_claim"), F.when(n % 2 == 1, (n - 24).cast("string")).alias("related_source_key")),
        "code": of("REDEEM_CODE").select("content_id", F.concat(F.lit("CODE"), text("number")).alias("code"), F.when(n % 3 == 0, "KR").alias("region")),
        "maintenance": of("MAINTENANCE").select("content_id", F.when(n % 3 != 0, "EMERGENCY").alias("maintenance_type"), F.when(n % 2 == 1, F.array("game_id", F.lit("all"))).alias("affected_servers"), (n + 6).cast("string").alias("compensation_source_key")),
        "banner": of("BANNER").select("content_id", F.when(n % 3 == 0, "WEAPON").alias("banner_type"), text("priority").alias("phase")),
        "change": line.select("content_id", "position", F.col("l_returnflag").alias("target_type"), text("l_partkey").alias("target_key"), part.alias("target_name"), F.lit("ADJUST").alias("change_type"), F.when(F.col("l_linenumber") % 2 == 0, "size").alias("field"), text("l_suppkey").alias("before_value"), text("l_linenumber").alias("after_value"), F.lit(None).cast("string").alias("unit"), F.col("l_linestatus").alias("description")),
        "item": line.select("content_id", "position", part.alias("name"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber").cast("double")).alias("quantity"), F.col("l_linestatus").alias("unit")),
        "featured": line.select("content_id", "position", part.alias("name"), text("l_partkey").alias("entity_key"), F.col("l_linenumber").cast("int").alias("rarity")),
    }
    return i.select("id", "type", "source_id", "source_key", "slug"), tables


@query
def content_details(spark: SparkSession, sf: str) -> DataFrame:
    """The details of all records with their children and links, as JSON."""
    return DT.hydrated(*detail_tables(spark, sf)).select("id", "type", F.to_json("detail").alias("detail"))


@query
def nested_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Every value inside the details of candidates that has not the form it should, by its path. Orders are candidates, their
    lines the elements; now and then a value is bad."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    k, text = F.col("k"), lambda: F.lit(None).cast("string")
    name = lambda x: F.when(x["l_partkey"] % 7 == 0, "").otherwise("p").alias("name")
    each = lambda f: F.transform("lines", f)
    items = each(lambda x: F.struct(name(x), F.when(x["l_partkey"] % 5 != 0, x["l_linenumber"] - 2.0).alias("quantity"), text().alias("unit")))
    changes = each(lambda x: F.struct(
        F.when(x["l_partkey"] % 2 == 0, "ITEM").otherwise(x["l_returnflag"]).alias("targetType"), text().alias("targetKey"), name(x).alias("targetName"), F.lit("BUFF").alias("changeType"), text().alias("field"),
        text().alias("beforeValue"), F.when(x["l_suppkey"] % 9 == 0, "").alias("afterValue"), text().alias("unit"), text().alias("description"),
    ))
    details = {
        "patch": F.when(k % 16 != 0, F.struct(F.when(k % 5 != 0, F.concat(F.lit("1."), k.cast("string"))).alias("version"), F.lit(None).cast("timestamp_ntz").alias("releaseAt"), changes.alias("changes"))),
        "event": F.struct(F.when(k % 3 == 0, "LOGIN").otherwise("PARTY").alias("eventType"), F.repeat(F.lit("x"), (k % 400).cast("int")).alias("eligibility"), text().alias("rewardSummary"), items.alias("rewards")),
        "reward": F.struct(F.lit("LOGIN").alias("rewardType"), text().alias("howToClaim"), F.when(k % 3 != 0, items).alias("items"), text().alias("relatedSourceKey")),
        "redeemCode": F.struct(F.when(k % 3 == 0, "a b").otherwise("CODE1").alias("code"), text().alias("region"), items.alias("items")),
        "maintenance": F.struct(F.lit("SCHEDULED").alias("maintenanceType"), each(lambda x: name(x)).alias("affectedServers"), text().alias("compensationSourceKey")),
        "banner": F.struct(F.lit("WEAPON").alias("bannerType"), (k % 13).alias("phase"), each(lambda x: F.struct(F.lit("f").alias("name"), text().alias("entityKey"), (x["l_linenumber"] + 2).alias("rarity"))).alias("featured")),
    }
    kind = F.element_at(F.array(*[F.lit(t) for t in M.CONTENT_TYPES]), (k % 8 + 1).cast("int"))
    # out of a generator, so that the details stand once
    built = rows.select("k", kind.alias("kind"), F.explode(F.array(F.struct(*[c.alias(n) for n, c in details.items()]))).alias("d"))
    found = SH.detail_issues(F.col("kind"), {n: F.col(f"d.{n}") for n in details})
    return built.select("k", F.explode(found).alias("i")).select(F.col("k").alias("candidate"), "i.code", "i.severity", "i.field")


@query
def localized_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts after a batch of line items has named some of them anew, by origin."""
    of = lambda id_: (F.lit("game_entity").alias("entity_kind"), id_.cast("string").alias("entity_id"), F.lit("en-US").alias("locale"), F.lit("name").alias("field"))
    stored = read(spark, sf, "part").where("p_partkey % 3 <> 0").select(*of(F.col("p_partkey")), F.col("p_name").alias("value"), F.lit("HUMAN").alias("origin"))
    new = read(spark, sf, "lineitem").where("l_partkey % 4 = 0").select(*of(F.col("l_partkey")), F.concat_ws(" ", F.lit("part"), "l_partkey", "l_orderkey").alias("value"), F.lit("SOURCE").alias("origin"), F.col("l_orderkey").alias("number"))
    return DT.localized(stored, new).select("entity_id", "value", "origin")


@query
def entity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that a batch adds: parts named by line items against the parts already known."""
    names = read(spark, sf, "lineitem").select(F.lit("PART").alias("type"), F.col("l_partkey").cast("string").alias("key"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"))
    known = read(spark, sf, "part").where("p_partkey % 3 = 0").select(F.lit("PART").alias("type"), F.col("p_partkey").cast("string").alias("key"), F.col("p_partkey").cast("string").alias("entity_id"))
    resolved, new = L.with_entities(names, known)
    counts = resolved.groupBy(F.when(F.length("entity_id") == 36, "new").otherwise("known").alias("state")).agg(F.count("*").alias("rows"), F.countDistinct("entity_id").alias("entities"))
    return counts.unionByName(new.agg(F.lit("added").alias("state"), F.count("*").alias("rows"), F.countDistinct("entity_id").alias("entities")))


@query
def viewer_preferences(spark: SparkSession, sf: str) -> DataFrame:
    """Stored preferences of customers made good."""
    k = F.col("c_custkey")
    games = F.array(*[F.lit(g) for g in ("lol", "wuwa", "lol", "chess", "genshin")])
    rows = read(spark, sf, "customer").select(
        k.alias("viewer"),
        F.slice(games, F.lit(1), (k % 6).cast("int")).alias("selected"),
        F.transform(F.sequence(F.lit(1), (k % 700 + 1).cast("int")), lambda i: F.concat(F.lit("d"), i.cast("string"))).alias("dismissed"),
        F.when(k % 3 == 0, "Asia/Tokyo").when(k % 3 == 1, "Mars/Base").otherwise("UTC+8").alias("timezone"),
        F.when(k % 2 == 0, "en-US").otherwise("xx").alias("locale"),
    )
    good = G.preferences(rows)
    return good.select("viewer", F.array_join(G.effective_games(F.col("selected")), ",").alias("games"), F.size("dismissed").alias("n_dismissed"), F.element_at("dismissed", 1).alias("first_dismissed"), "timezone", "locale")


@query
def viewer_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Published items of a viewer's games without what they have put away."""
    selected = spark.createDataFrame([("lol",), ("wuwa",)], "game_id string")
    dismissed = D7.items(spark, sf).where("number % 4 = 0").select("id")
    return C.for_viewer(D7.published(spark, sf), selected, dismissed).select("id", "game_id")


ADAPTERS = (
    G.Adapter("a-live", "lol", ("live", "mock"), "ENABLED", ("API_KEY",), 15),
    G.Adapter("b-paused", "lol", ("live",), "PAUSED", (), 15),
    G.Adapter("c-keyless", "lostark", ("live", "mock"), "ENABLED", ("OTHER_KEY", "API_KEY"), 30),
    G.Adapter("d-manual", "maplestory", ("live",), "ENABLED"),
    G.Adapter("e-fixture", "genshin", ("fixture",), "ENABLED"),
)


@query
def schedule_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What is scheduled, and why the rest is not, in three modes: some adapters by hand, and one for each supplier."""
    k = F.col("s_suppkey")
    modes = F.filter(F.array(F.when(k % 5 != 0, "live"), F.when(k % 2 == 0, "mock"), F.when(k % 3 == 0, "fixture")), lambda m: m.isNotNull())
    keys = F.when(k % 7 == 0, F.array(F.lit("OTHER_KEY"))).when(k % 7 == 1, F.array(F.lit("API_KEY"))).otherwise(F.array().cast("array<string>"))
    own = read(spark, sf, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("adapter_id"), F.lit("lol").alias("game_id"), modes.alias("modes"), F.when(k % 4 == 0, "PAUSED").otherwise("ENABLED").alias("collector_status"), keys.alias("credentials"), F.when(k % 11 != 0, (k % 60 + 1).cast("int")).alias("every_minutes"))
    a = G.adapters_table(spark, ADAPTERS).unionByName(own)
    plans = [G.schedule(a, mode, ("API_KEY",)).withColumn("mode", F.lit(mode)) for mode in ("live", "mock", "fixture")]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


@query
def sitemap_rows(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.createDataFrame([("/", "hourly", 1.0), ("/today", "hourly", 0.8), ("/terms", "monthly", 0.2)], "path string, frequency string, priority double")
    rows = C.with_paths(D7.published(spark, sf).withColumn("slug", F.concat_ws("-", "game_id", "id")))
    return G.sitemap(rows, pages, "https://example.com")


@query
def adapter_health(spark: SparkSession, sf: str) -> DataFrame:
    """Health of each supplier's nation from checks of its suppliers."""
    s = read(spark, sf, "supplier")
    return s.groupBy("s_nationkey").agg(G.health(F.col("s_acctbal") > 0).alias("health"), F.count("*").alias("checks"))


@query
def http_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Retry, waiting and protection rules over answers made of events."""
    e = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 403, 404, 408, 429, 500, 503)]), (e % 7 + 1).cast("int"))
    body = F.when(e % 5 == 0, "please solve the CAPTCHA").otherwise("fine")
    after = F.when(e % 3 == 0, (e % 90).cast("string")).when(e % 3 == 1, "Tue, 16 Jan 2024 00:01:00 GMT")
    reset = F.when(e % 4 == 0, (e % 60).cast("string")).when(e % 4 == 1, "1705363260").when(e % 4 == 2, "1705363260000")
    return read(spark, sf, "events").select(e.alias("number"), G.retryable(status).alias("retry"), G.challenged(status, F.lit(None).cast("string"), body).alias("challenged"), G.retry_after(after, now()).alias("wait_ms"), G.rate_limit_reset(reset, now()).alias("reset_ms"), G.backoff_ceiling(e % 9).alias("ceiling_ms"))


@query
def request_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events within the last day, at each event."""
    rows = read(spark, sf, "events").select("event_id", F.col("user_id").alias("host"), F.col("ts").alias("at"))
    return ingest.requests_within(rows, 86_400).select("event_id", "recent")


@query
def window_matches(spark: SparkSession, sf: str) -> DataFrame:
    """How many published items touch the window that each viewer looks at, and which is the first."""
    k = F.col("s_suppkey")
    first = S.instant("2024-01-01 00:00:00") + F.make_dt_interval(F.lit(0), (k * 7919 % 720).cast("int"), F.lit(30))
    windows = read(spark, sf, "supplier").select(k.alias("window_id"), first.alias("first"), (first + F.make_dt_interval(F.lit(0), (k % 48).cast("int"))).alias("last"))
    at = S.effective()
    span = F.when(S.point_in_time(), F.struct(at.alias("a"), at.alias("b"), at.isNotNull().alias("known"))).otherwise(F.struct(F.col("start_at").alias("a"), F.col("end_at").alias("b"), F.lit(True).alias("known")))
    items = D7.published(spark, sf).select("id", "number", span.alias("s")).where("s.known").select(F.col("number").alias("id"), F.col("s.a").alias("start_at"), F.col("s.b").alias("end_at"))
    return V.tallied(items, windows)


@query
def run_admissions(spark: SparkSession, sf: str) -> DataFrame:
    """Which runs of each adapter got its lock, and which lock each found stale: users' events as runs of some minutes or
    hours, some of which never end."""
    e, minutes = F.col("event_id"), (F.floor(F.col("value") * 7) % 600 + 1).cast("int")
    finish = F.when(e % 7 != 0, F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes))
    runs = read(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("adapter_id"), e.cast("string").alias("run_id"), F.col("ts").alias("started_at"), finish.alias("finished_at"))
    return RN.admitted(runs, timedelta(hours=6))


def limited_events(spark: SparkSession, sf: str) -> DataFrame:
    """Requests and answers of a rate limiter: every fifth event is an answer, of which some ask for a pause."""
    e = F.col("event_id")
    rows = read(spark, sf, "events").select(F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string")).alias("host"), e.alias("id"), F.col("ts").alias("at"))
    n = F.col("id")
    told = rows.where("id % 5 = 0").select("*", F.when(n % 25 == 0, 429).otherwise(200).alias("status"), F.when(n % 3 == 0, "100").alias("limit"), F.when(n % 10 == 0, "0").otherwise("7").alias("remaining"), F.when(n % 2 == 0, "5400").alias("reset"), F.when(n % 50 == 0, "7200").alias("retry_after"))
    return limiter.requests(rows.where("id % 5 <> 0")).unionByName(limiter.answers(told))


#: What a host takes in the query and its test: two requests an hour, a quarter of an hour apart.
POLICY = limiter.Policy(2, timedelta(hours=1), timedelta(minutes=15))


@query
def rate_grants(spark: SparkSession, sf: str) -> DataFrame:
    """When each request may start, out of a stream that takes requests and answers in two batches."""
    staged, state, out = (session.scratch(spark, f"limiter-{n}") for n in ("in", "state", "out"))
    events = session.written(limited_events(spark, sf), "limited")
    provider = "spark.sql.streaming.stateStore.providerClass"
    usual = spark.conf.get(provider)
    spark.conf.set(provider, limiter.PROVIDER)
    early = F.col("at") < now()
    try:
        for n, rows in enumerate((events.where(early), events.where(~early))):
            rows.write.parquet(f"{staged}/part={n}")
            grants = limiter.granted(ingest.files(spark, f"{staged}/*", events.schema, per_batch=1_000_000), POLICY)
            grants.writeStream.format("parquet").option("path", f"{out}/grants").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, usual)
    return spark.read.parquet(f"{out}/grants")


@query
def stale_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs by status after those that hang are given up."""
    e = F.col("event_id")
    runs = read(spark, sf, "events").select(F.when(e % 3 == 0, "RUNNING").otherwise("SUCCEEDED").alias("status"), F.col("ts").alias("started_at"))
    return G.abandoned(runs, now()).groupBy("status").agg(F.count("*").alias("runs"))


@query
def item_badges(spark: SparkSession, sf: str) -> DataFrame:
    """Tone and label of each item's badge, and the instant that matters next."""
    rows = S.with_states(D7.published(spark, sf), now()).withColumns({"p": S.presentation(now()), "f": S.focus()})
    return rows.select("id", "p.tone", "p.label", F.col("f.kind").alias("focus"), F.col("f.at").alias("focus_at"))


@query
def status_over_time(spark: SparkSession, sf: str) -> DataFrame:
    """The same classification at many instants: items of each status on every day of a month. An item is counted where its
    status begins and where it ends, and the counts are summed up over the days."""
    first, last = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-01", "2024-01-31"))
    return views.statuses_by_day(D7.published(spark, sf), first, last)


@query
def previous_reset(spark: SparkSession, sf: str) -> DataFrame:
    return R.previous_occurrence(D7.reset_rules(spark, sf), now()).select(F.col("id").alias("rule_id"), "game_id", "previous_at")


@query
def game_overview(spark: SparkSession, sf: str) -> DataFrame:
    """The latest three patches of each game."""
    patches = D7.published(spark, sf).where(S.is_type("PATCH"))
    w = W.partitionBy("game_id").orderBy(S.effective().desc(), "id")
    return patches.withColumn("place", F.row_number().over(w)).where("place <= 3").select("game_id", "place", "id")


@query
def source_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by game and strength, their development twins beside them; the later table's row of an id holds."""
    s = read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    from ..functions import model as M

    base = s.select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.element_at(F.array(*[F.lit(g) for g in M.GAMES]), (k % 5 + 1).cast("int")).alias("game_id"), F.element_at(F.array(*[F.lit(t) for t in M.SOURCE_TYPES]), (k % 6 + 1).cast("int")).alias("type"), F.lit("key").alias("authentication"), F.lit(True).alias("is_official"))
    every = G.last_by_id(base, G.twins(base, "mock-"), base.where("id like '%7'").withColumn("type", F.lit("OFFICIAL_WEB")))
    return G.by_type_rank(every).select("game_id", "id", "type")


@query
def recorded_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages answered from recorded routes."""
    routes = spark.createDataFrame([(0, "https://blog.a.example.net/", "prefix", 200, "blog"), (1, "https://none.example/", "exact", 500, "x")], "position int, url string, match string, status int, body string")
    pages = read(spark, sf, "pages").select("page_id", "url")
    # routes of hosts that the pages really have: one prefix for each host of an even length
    hosts = pages.select(X.host(F.col("url")).alias("h")).distinct().where((F.col("h") != "") & (F.length("h") % 2 == 0))
    more = hosts.select(F.lit(5).alias("position"), F.concat(F.lit("https://"), "h", F.lit("/")).alias("url"), F.lit("prefix").alias("match"), F.lit(200).alias("status"), F.col("h").alias("body"))
    return feeds.recorded(pages, routes.unionByName(more)).select("page_id", "http_status", F.col("raw_text").alias("body"))


ROBOTS = """# what crawlers may read
User-agent: other
User-agent: crawl
Allow: /a*e
Disallow: /a
Disallow: /*9$

User-agent: *
Disallow: /
"""


@query
def robots_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Which paths of the pages a crawler may read: hosts answer with a file, a failure or nothing at all by turns."""
    pages = read(spark, sf, "pages").select(X.host(F.col("url")).alias("host"), F.regexp_extract("url", r"^https?://[^/]+(/[^#]*)", 1).alias("path")).where("host <> ''")
    size = F.length("host") % 4
    answers = pages.select("host").distinct().select("host", F.when(size == 0, 503).when(size == 1, 404).otherwise(200).alias("status"), F.when(size == 2, ROBOTS).when(size == 3, "Sitemap: /x").alias("body"), now().alias("fetched_at"))
    return RB.allowed(pages, RB.rules(RB.fresh(answers, now())), "Crawler/1.0 (+https://example.com)")


@query
def stream_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events of each type in windows of an hour of event time, counted by a stream."""
    path = f"{sf}/events.parquet*"  # the table is one file; a pattern makes it a source that files may join
    source = ingest.files(spark, path, read(spark, sf, "events").schema).withColumn("at", F.col("ts").cast("timestamp"))
    counted = ingest.windowed_counts(source, "at", "1 hour", "event_type", late="60 days")
    done = ingest.drained(counted, ["window_start", "event_type"], session.scratch(spark, "windows"), session.scratch(spark, "windows-state"))
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "rows")


@query
def batch_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What two batches report of themselves, counted while they were written."""
    log = ingest.ContentLog(spark, session.scratch(spark, "counted"), now(), bucket_rows=2_500)
    for n, rows in enumerate(_batches(spark, sf)):
        log.apply(rows, n)
    fields = ["discovered", *(o.replace("-", "_") for o in P.OUTCOMES), *(v.lower() for v in M.VALIDATION_STATUSES)]
    return spark.createDataFrame([(n, *(int(c[f]) for f in fields)) for n, c in log.counters.items()], "batch int, " + ", ".join(f"{f} long" for f in fields))


@query
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """What a store holds after a stream has published two micro-batches into it, one after the other."""
    staged, log = session.scratch(spark, "candidates"), ingest.ContentLog(spark, session.scratch(spark, "content"), now())
    state = session.scratch(spark, "content-state")
    for n, rows in enumerate(_batches(spark, sf)):
        # each run of the stream takes the files that have come since the last
        rows.drop("validation").write.parquet(f"{staged}/part={n}")
        ingest.ingest(ingest.files(spark, f"{staged}/*", rows.drop("validation").schema, per_batch=1_000_000), log, state).awaitTermination()
    records = log.current().groupBy("source_id", "status").agg(F.count("*").alias("rows"))
    sightings = log.sightings().groupBy("source_id", F.col("role").alias("status")).agg(F.count("*").alias("rows"))
    return records.select(F.lit("record").alias("of"), "*").unionByName(sightings.select(F.lit("sighting").alias("of"), "*"))
