"""Registered queries over the store, short forms and texts. ``store_oracles.py`` has the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import state as S
from ..functions import times as T
from ..operators import content as C
from ..operators import publish as P
from ..operators import pulse as U
from ..operators import registry as G
from ..operators import store as ST
from ..sources import feeds
from . import driver_views as D7
from .driver_views import now, read
from .queries import query


def _sources(spark: SparkSession) -> DataFrame:
    rows = [(f"src-{i}", f"source {i}", t, f"https://{i}.example") for i, t in enumerate(D7.M.SOURCE_TYPES, 1)]
    return spark.createDataFrame(rows, "source_id string, name string, type string, url string")


def _content(spark: SparkSession, sf: str) -> DataFrame:
    """Items with everything a short form reads."""
    e = F.col("number")
    change = lambda i: F.struct(F.concat(F.lit("thing "), i.cast("string")).alias("name"), F.when(i % 2 == 0, "power").alias("field"), F.when(i != 3, i.cast("string")).alias("before"), (i + 1).cast("string").alias("after"))
    many = lambda n: F.slice(F.sequence(F.lit(1), F.lit(6)), F.lit(1), n.cast("int"))
    detail = F.struct(F.concat(F.lit("1."), e.cast("string")).alias("version"), F.transform(many(e % 6), change).alias("changes"), F.lit("KIND").alias("label"), F.concat(F.lit("C"), e.cast("string")).alias("code"), F.transform(many(e % 7), lambda i: F.concat(F.lit("item "), i.cast("string"))).alias("items"))
    rows = D7.items(spark, sf).drop("source_type").withColumns({"source_id": F.concat(F.lit("src-"), F.col("authority").cast("string")), "slug": F.concat_ws("-", "game_id", "id"), "summary": F.when(e % 3 == 0, F.concat(F.lit("  about\n"), "title")), "precision": F.when(e % 4 == 0, "DATE"), "verification": F.lit("UNVERIFIED"), "source_url": F.lit("https://x.example/"), "detail": detail})
    return ST.with_source(rows, _sources(spark))


@query
def pulse_items(spark: SparkSession, sf: str) -> DataFrame:
    """The short form of every published item."""
    rows = U.pulse_items(_content(spark, sf).where("status = 'PUBLISHED'"))
    text = lambda c: F.array_join(F.col(f"facts.{c}"), "; ")
    return rows.select("id", "href", "precision", "source_name", "facts.version", "facts.change_count", text("changes").alias("changes"), "facts.label", "facts.code", text("items").alias("items"))


@query
def slug_list(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of the 500 items that changed last: a top-k report."""
    return U.slugs(_content(spark, sf), 500)


@query
def content_page(spark: SparkSession, sf: str) -> DataFrame:
    """One page by its slug, with its description and JSON-LD."""
    rows = U.by_slug(_content(spark, sf), "lol-15").unionByName(U.by_slug(_content(spark, sf), "lostark-1"))
    return rows.select("id", "slug", U.description(F.col("title"), F.col("summary")).alias("description"), G.json_ld("Event", name=F.concat(F.lit("<"), F.col("title")), url=F.col("source_url")).alias("json_ld"), C.indexable(F.col("summary")).alias("indexable"))


@query
def game_tabs(spark: SparkSession, sf: str) -> DataFrame:
    """Items that each tab of each game shows."""
    rows = U.game_window(D7.items(spark, sf), ("lol", "lostark", "genshin"), now()).withColumn("tab", U.game_tab(F.col("type")))
    return rows.where("tab is not null").groupBy("game_id", "tab").agg(F.count("*").alias("items"))


@query
def game_features(spark: SparkSession, sf: str) -> DataFrame:
    """Tabs and features of games: nations with support that differs by key."""
    k = F.col("n_nationkey")
    level = lambda n: F.element_at(F.array(*[F.lit(x) for x in ("supported", "limited", "unsupported")]), (n % 3 + 1).cast("int"))
    features = F.create_map(*[x for i, f in enumerate(("patches", "events", "banners", "rewards", "redeemCodes", "resets")) for x in (F.lit(f), level(k + i * (k % 2 + 1)))])
    games = read(spark, sf, "nation").select(F.col("n_name").alias("game_id"), F.when(k % 5 == 0, "INACTIVE").otherwise("ACTIVE").alias("status"), features.alias("features"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return U.tabs(games).select("game_id", join("tabs"), join("features"), join("limited"))


@query
def hidden_items(spark: SparkSession, sf: str) -> DataFrame:
    """How many dismissed ids are among the published items."""
    gone = D7.items(spark, sf).select((F.col("number") * 3).cast("string").alias("id"))
    return U.hidden(D7.published(spark, sf), gone)


def _raw(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    raw = D7.raw_documents(spark, sf)
    first = raw.where(F.minute("fetched_at") == 0).groupBy(*ST.RAW_KEY).agg(F.min("raw_text").alias("raw_text"), F.min("fetched_at").alias("first_seen"), F.min("fetched_at").alias("last_checked"))
    return first.where(F.col("first_seen") < S.instant("2024-01-20 00:00:00")), raw.where(F.col("fetched_at") >= S.instant("2024-01-10 00:00:00"))


@query
def raw_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Raw documents of each source after a fetch: new, checked again, or kept."""
    stored, fetched = _raw(spark, sf)
    done = ST.touched_raw(ST.upserted_raw(stored, fetched), fetched.select("source_id", "document_key", F.lit("2024-03-01").cast("timestamp_ntz").alias("fetched_at")))
    return done.groupBy("source_id", "action").agg(F.count("*").alias("documents"), F.countDistinct("document_key").alias("keys"), F.count_if(F.col("last_checked") == S.instant("2024-03-01 00:00:00")).alias("touched"))


@query
def maintenance_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """What the daily job removes of each source with a time to live, and what stays."""
    i = D7.items(spark, sf).withColumn("source_id", F.concat(F.lit("src-"), F.col("authority").cast("string")))
    content = i.select(F.col("id").alias("content_id"), "source_id", F.col("published_at").alias("last_seen"))
    children = content.select("content_id", F.explode(F.sequence(F.lit(1), (F.length("content_id") % 3 + 1).cast("int"))).alias("position"))
    raw = i.select(F.col("id").alias("raw_id"), "source_id", (F.col("published_at") - F.expr("interval 2 day")).alias("last_checked"))
    parses = i.where("number % 2 = 0").select(F.col("id").alias("raw_id"), F.lit("OK").alias("status"))
    *kept, report = ST.swept(content, children, raw, parses, {"src-1": 3, "src-3": 7, "src-9": 1}, now())
    left = [df.agg(F.lit(name).alias("source_id"), F.count("*").alias("content"), F.lit(0).cast("bigint").alias("raw_documents"), F.lit(0).cast("bigint").alias("parse_results")) for name, df in zip(("content left", "children left", "raw left", "parses left"), kept, strict=True)]
    for df in left:
        report = report.unionByName(df)
    return report


@query
def provenance_names(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of each fact by name, the primary one first."""
    i = D7.candidates(spark, sf).select(F.concat_ws(":", "game_id", "kind", "title").alias("content_id"), "source_id", "source_key", F.col("start_at").alias("seen_at"), D7.M.authority(F.col("source_type")).alias("authority"))
    return ST.reported_by(P.provenance(i), _sources(spark)).where("place <= 3").select("content_id", "name", "role", "place")


@query
def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The last 50 runs after their reports: a top-k report."""
    e = F.col("event_id")
    runs = read(spark, sf, "events").select(e.alias("run_id"), F.lit("RUNNING").alias("status"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    reports = runs.where("run_id % 3 <> 0").select("run_id", F.when(F.col("run_id") % 2 == 0, "SUCCEEDED").otherwise("PARTIAL").alias("status"), (F.col("started_at") + F.expr("interval 5 minute")).alias("finished_at"))
    return ST.recent_runs(ST.finished_runs(runs, reports), 50).select("run_id", "status", "finished_at")


@query
def replaced_details(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of orders after some of them have been written anew."""
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("content_id"), F.col("l_linenumber").alias("position"), "l_partkey")
    again = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("content_id"))
    new = again.select("content_id", F.lit(1).cast(lines.schema["position"].dataType).alias("position"), F.lit(0).cast(lines.schema["l_partkey"].dataType).alias("l_partkey"))
    return ST.replaced_children(lines, new, again).groupBy("content_id").agg(F.count("*").alias("changes"), F.sum("l_partkey").alias("parts"))


@query
def version_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each published version and the one before it."""
    v = read(spark, sf, "part").select((-F.col("p_partkey")).alias("position"), F.concat(F.lit("14."), F.col("p_partkey").cast("string")).alias("version"))
    return ST.version_pairs(v)


@query
def period_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Periods, countdowns and stated local dates in words."""
    zone, precision = "Asia/Seoul", F.when(F.col("number") % 3 == 0, "DATE").otherwise("DATETIME")
    start, end = F.col("start_at"), F.col("end_at")
    stated = F.when(F.col("number") % 2 == 0, F.date_format("published_at", "yyyy-MM-dd")).otherwise(F.date_format("published_at", "yyyy-MM-dd HH:mm"))
    return D7.items(spark, sf).select(
        "id",
        T.period(start, end, zone, "en-US", precision).alias("period"),
        T.date_heading(F.col("published_at"), zone, "en-US").alias("heading"),
        T.countdown(F.coalesce(end, "published_at"), now(), zone, precision).alias("auto"),
        T.countdown(F.coalesce(end, "published_at"), now(), zone, precision, "clock").alias("clock"),
        T.countdown(F.coalesce(end, "published_at"), now(), zone, precision, "dday").alias("days"),
        T.stated_local(stated, F.lit("+09:00"), False).alias("from_at"),
        T.stated_local(stated, F.lit("+09:00"), True).alias("until_at"),
        T.add_months(F.col("published_at").cast("date"), 1).alias("next_month"),
    )


@query
def snapshot_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Champions and items of two snapshot files, read and compared end to end."""
    from ..operators import diff as D

    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")

    def champions(version: str, cost):
        spell = F.struct(F.lit("bolt").alias("name"), F.array(size).alias("cooldown"), F.array(cost).alias("cost"), F.array(F.lit(1.0)).alias("range"))
        one = F.struct(k.cast("string").alias("id"), F.col("p_name").alias("name"), F.create_map(F.lit("hp"), size).alias("stats"), F.array(spell).alias("spells"))
        # a file for each thousand parts: a file is one document
        return p.groupBy(F.floor(k / 1000)).agg(F.to_json(F.struct(F.lit(version).alias("version"), F.map_from_entries(F.collect_list(F.struct(k.cast("string"), one))).alias("data"))).alias("raw_text")).select("raw_text")

    def items(version: str, gold):
        one = F.struct(F.col("p_name").alias("name"), F.struct(gold.alias("total"), (k % 4 != 0).alias("purchasable")).alias("gold"), F.create_map(F.lit("power"), size).alias("stats"), F.create_map(F.lit(feeds.MAP_ID), F.lit(True)).alias("maps"))
        return p.groupBy(F.floor(k / 1000)).agg(F.to_json(F.struct(F.lit(version).alias("version"), F.map_from_entries(F.collect_list(F.struct(k.cast("string"), one))).alias("data"))).alias("raw_text")).select("raw_text")

    before, after = (feeds.champion_snapshot(champions(v, size + n)) for v, n in (("1", k % 2), ("2", F.lit(0))))
    old, new = (feeds.item_snapshot(items(v, size * 10 + n)) for v, n in (("1", F.lit(0)), ("2", (k % 3 == 0).cast("int"))))
    return D.champion_changes(before, after).select("target_type", "target_key", "change", "field").unionByName(D.item_changes(old, new).select("target_type", "target_key", "change", "field"))
