"""Feeds of announcements as DataFrames of candidates.

Every normalizer takes raw documents (document_key, url, raw_text and what else the rows carry) and gives two tables:
candidates in one common shape, and rejected items with a reason. One bad item never fails a job. Item lists are read as
arrays of JSON texts first, so an item of a wrong shape is one rejected row and not a lost document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as X
from ..functions import times as T

#: Columns of a candidate and their types; normalizers fill what they know.
CANDIDATE = {
    "kind": "string", "game_id": "string", "source_key": "string", "slug_hint": "string", "title": "string", "summary": "string",
    "start_at": "timestamp_ntz", "end_at": "timestamp_ntz", "source_timezone": "string", "start_at_source": "string", "end_at_source": "string",
    "region": "string", "precision": "string", "source_url": "string", "source_published_at": "timestamp_ntz", "source_locale": "string",
    "priority": "int", "confidence": "double", "is_synthetic": "boolean", "maintenance_type": "string", "version": "string", "code": "string",
    "related_source_key": "string",
}
KST = "Asia/Seoul"
TITLE_MOST, SUMMARY_MOST = 200, 300


@dataclass(frozen=True)
class Normalized:
    candidates: DataFrame
    rejected: DataFrame


def candidate(**known: Column | str | int | float | bool | None) -> Column:
    """A struct of all candidate columns; those not named are null."""
    extra = known.keys() - CANDIDATE.keys()
    if extra:
        raise ValueError(f"no candidate columns: {sorted(extra)}")
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[value(known.get(n)).cast(t).alias(n) for n, t in CANDIDATE.items()])


def _split(rows: DataFrame, made: Column, reason: Column) -> Normalized:
    """``made``: an array of candidates (nulls in it are dropped); ``reason``: why an item has none, or null."""
    keep = [c for c in ("document_key", "position") if c in rows.columns]
    # out of a generator, so that the filters below do not repeat the long expressions
    judged = rows.select(*keep, F.explode(F.array(F.struct(F.array_compact(made).alias("made"), reason.alias("reason")))).alias("j")).select(*keep, "j.*")
    good = judged.where("reason is null").select(F.explode("made").alias("c")).select("c.*")
    return Normalized(good, judged.where("reason is not null").select(*keep, "reason"))


def raw_documents(rows: DataFrame, source_id: str, fetched_at: Column) -> DataFrame:
    """Rows (url, raw_text and optional external_id, http_status) as raw documents with key, hash and ``not_modified``:
    an answer 304 has an empty text."""
    out = rows
    for name, kind in (("external_id", "string"), ("http_status", "int"), ("raw_text", "string")):
        if name not in rows.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    unchanged = F.coalesce(F.col("http_status") == 304, F.lit(False))
    body = F.when(unchanged, "").otherwise(F.coalesce("raw_text", F.lit("")))
    return out.select(
        F.lit(source_id).alias("source_id"),
        F.coalesce("external_id", "url").alias("document_key"),
        "url",
        body.alias("raw_text"),
        I.sha256(body).alias("content_hash"),
        fetched_at.alias("fetched_at"),
        "http_status",
        unchanged.alias("not_modified"),
    )


def recorded(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """``requests`` (url) answered from recorded routes (position, url, match, status, body): the first route that equals
    the URL, or that the URL begins with where ``match`` is prefix; 404 without one.

    Routes are a hand-written table and requests follow the number of sources: exact routes are an equi-join, prefixes join
    on their host, so a request meets the routes of its own host alone.
    """
    r = routes.select("position", F.col("url").alias("route"), "match", "status", "body")
    q = requests.select("url").distinct()
    exact = q.join(r.where("match = 'exact'"), F.col("url") == F.col("route"))
    prefix = q.withColumn("h", X.host(F.col("url"))).join(r.where("match = 'prefix'").withColumn("rh", X.host(F.col("route"))), (F.col("h") == F.col("rh")) & F.col("url").startswith(F.col("route"))).drop("h", "rh")
    first = exact.unionByName(prefix).groupBy("url").agg(F.min_by(F.struct("status", "body"), "position").alias("r"))
    answered = requests.join(first, "url", "left")
    return answered.select(*requests.columns, F.coalesce("r.status", F.lit(404)).alias("http_status"), F.when(F.col("r").isNull(), "not found").otherwise(F.coalesce("r.body", F.lit(""))).alias("raw_text"))


# --- synthetic and manual files

_ITEM = (
    "key string, kind string, title string, summary string, slugHint string, startAt string, endAt string, timing string, "
    "sourceUrl string, sourcePublishedAt string, priority int, confidence double, redeemCode struct<code:string>, patch struct<version:string>, "
    "maintenance struct<maintenanceType:string>, reward struct<relatedSourceKey:string>"
)
SYNTHETIC_FEED = f"gameId string, timezone string, locale string, region string, documents array<struct<externalId:string,url:string,publishedAt:string,items:array<string>>>"


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as raw documents: document_key is the file's name."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw_text"), F.col("_metadata.file_name").alias("document_key"), F.col("_metadata.file_path").alias("url"))
    return rows


def _source_text(at: Column, zone: Column) -> Column:
    wall = T.to_wall(at, zone)
    return F.concat(F.date_format(wall, "yyyy/MM/dd HH:mm"), F.lit(" ("), T.offset_label(T.offset_minutes(at, zone)), F.lit(")"))


def synthetic_feed(raw: DataFrame, anchor: Column, asked: Column | None = None) -> Normalized:
    """Development feeds: times may be relative to ``anchor``; an item's key is ``document#item``; all are synthetic. ``asked``:
    the game that was asked for; a feed that declares another one gives no candidates."""
    feed = raw.select(F.col("document_key").alias("file"), (F.lit(None).cast("string") if asked is None else asked).alias("asked"), F.from_json("raw_text", SYNTHETIC_FEED).alias("f"))
    docs = feed.select("asked", "f.gameId", F.col("f.timezone").alias("stated"), T.normal_zone(F.col("f.timezone")).alias("zone"), "f.locale", "f.region", F.explode("f.documents").alias("d"))
    items = docs.select("*", F.col("d.externalId").alias("document_key"), F.posexplode("d.items").alias("position", "text"))
    items = items.withColumn("i", F.from_json("text", _ITEM))
    at = lambda c: T.relative_time(F.col(c), anchor, F.col("zone"))
    items = items.withColumns({"start": at("i.startAt"), "end": at("i.endAt"), "published": F.coalesce(at("i.sourcePublishedAt"), at("d.publishedAt"))})
    auto = F.col("i.timing") == "auto"
    made = candidate(
        kind=F.col("i.kind"), game_id=F.col("gameId"), source_key=F.concat_ws("#", "document_key", "i.key"), slug_hint=F.col("i.slugHint"), title=F.col("i.title"), summary=F.col("i.summary"),
        start_at=F.col("start"), end_at=F.col("end"), source_timezone=F.when(auto, F.col("stated")), start_at_source=F.when(auto, _source_text(F.col("start"), F.col("zone"))),
        end_at_source=F.when(auto, _source_text(F.col("end"), F.col("zone"))), region=F.when(auto, F.col("region")), precision=F.when(auto, "DATETIME"),
        source_url=F.coalesce("i.sourceUrl", "d.url"), source_published_at=F.col("published"), source_locale=F.col("locale"), priority=F.coalesce("i.priority", F.lit(50)),
        confidence=F.coalesce("i.confidence", F.lit(1.0)), is_synthetic=True, code=F.col("i.redeemCode.code"), version=F.col("i.patch.version"),
        maintenance_type=F.col("i.maintenance.maintenanceType"), related_source_key=F.col("i.reward.relatedSourceKey"),
    )
    bad_time = lambda c, t: F.col(c).isNotNull() & F.col(t).isNull()
    reason = F.when(F.col("asked") != F.coalesce("gameId", F.lit("")), "another game").when(F.col("i.key").isNull() | F.col("i.kind").isNull() | F.col("i.title").isNull(), "unexpected shape").when(bad_time("i.startAt", "start") | bad_time("i.endAt", "end"), "bad time")
    return _split(items, F.array(made), reason)


MANUAL_FILE = "gameId string, note string, items array<string>"


#: Items of an operator's file at most.
MANUAL_MOST = 200


def manual_items(raw: DataFrame, locale: str = "ko-KR", asked: Column | None = None) -> Normalized:
    """Operators' files: missing fields get defaults; an item without a key is named by what it says. A file with more than
    MANUAL_MOST items, or of another game than ``asked``, gives no candidates."""
    files = raw.select("document_key", (F.lit(None).cast("string") if asked is None else asked).alias("asked"), F.from_json("raw_text", MANUAL_FILE).alias("f"))
    files = files.select("document_key", "asked", "f.gameId", F.size("f.items").alias("items"), F.posexplode("f.items").alias("position", "text"))
    rows = files.withColumn("i", F.from_json("text", _ITEM + ", sourceKey string, isSynthetic boolean"))
    own = F.to_json(F.struct(F.col("i.kind").alias("kind"), F.col("i.startAt").alias("startAt"), F.col("i.title").alias("title")), {"ignoreNullFields": "false"})
    at = lambda c: T.stated_instant(F.col(c))
    made = candidate(
        kind=F.col("i.kind"), game_id=F.col("gameId"), source_key=F.coalesce(F.nullif("i.sourceKey", F.lit("")), F.concat(F.lit("manual-"), I.fnv1a32(own))), slug_hint=F.col("i.slugHint"),
        title=F.col("i.title"), summary=F.col("i.summary"), start_at=at("i.startAt"), end_at=at("i.endAt"), source_url=F.col("i.sourceUrl"), source_published_at=at("i.sourcePublishedAt"),
        source_locale=locale, priority=F.coalesce("i.priority", F.lit(50)), confidence=F.coalesce("i.confidence", F.lit(1.0)), is_synthetic=F.coalesce("i.isSynthetic", F.lit(False)),
        code=F.col("i.redeemCode.code"), version=F.col("i.patch.version"), maintenance_type=F.col("i.maintenance.maintenanceType"), related_source_key=F.col("i.reward.relatedSourceKey"),
    )
    reason = F.when(F.col("asked") != F.coalesce("gameId", F.lit("")), "another game").when(F.col("items") > MANUAL_MOST, "too many items").when(F.col("i.kind").isNull() | F.col("i.title").isNull() | F.col("i.sourceUrl").isNull(), "unexpected shape").when(F.col("i.startAt").isNotNull() & at("i.startAt").isNull(), "bad time")
    return _split(rows, F.array(made), reason)


def text_documents(raw: DataFrame, hosts: Column) -> DataFrame:
    """Text or HTML files whose official https address is allowed, as readable text."""
    good = F.col("url").startswith("https://") & X.host_allowed(F.col("url"), hosts)
    return raw.where(good).withColumn("document_text", X.html_text(F.col("raw_text")))


# --- service status

_STATUS = (
    "id bigint, maintenance_status string, incident_severity string, titles array<struct<locale:string,content:string>>, "
    "updates array<struct<translations:array<struct<locale:string,content:string>>,created_at:string,updated_at:string>>, created_at string"
)
#: The languages that a status is shown in, by preference.
LOCALES = ("ko_KR", "en_US")


def localized(entries: Column) -> Column:
    """The first entry with text in the preferred languages, as one line."""
    of = lambda locale: F.get(F.filter(entries, lambda e: (e["locale"] == locale) & (F.trim(e["content"]) != "")), F.lit(0))["content"]
    return X.single_line(X.plain_text(F.coalesce(*[of(locale) for locale in LOCALES])))


def service_status(raw: DataFrame, page: str, game: str = "lol", synthetic: bool = False) -> Normalized:
    """All maintenances, and incidents that are more than information. Windows are not stated there: times stay unknown."""
    lists = raw.select("document_key", F.from_json("raw_text", "maintenances array<string>, incidents array<string>").alias("s"))
    none = F.array().cast("array<string>")

    def marked(name: str, kind: str) -> Column:
        return F.transform(F.coalesce(f"s.{name}", none), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    every = F.concat(marked("maintenances", "MAINTENANCE"), marked("incidents", "ANNOUNCEMENT"))
    rows = lists.select("document_key", F.posexplode(every).alias("position", "e")).select("document_key", "position", "e.kind", F.from_json("e.text", _STATUS).alias("i"))
    rows = rows.where((F.col("kind") == "MAINTENANCE") | ~F.coalesce(F.col("i.incident_severity") == "info", F.lit(False)))
    when = lambda u: F.coalesce(u["updated_at"], u["created_at"], F.lit(""))
    newest = F.get(F.filter("i.updates", lambda u: when(u) == F.array_max(F.transform("i.updates", when))), F.lit(0))
    rows = rows.withColumns({"title": localized(F.col("i.titles")), "update": localized(newest["translations"])})
    name = F.when(F.col("kind") == "MAINTENANCE", "maintenance").otherwise("incident")
    number = F.col("i.id").cast("string")
    made = candidate(
        kind=F.col("kind"), game_id=game, source_key=F.concat_ws(":", name, number), slug_hint=F.concat_ws("-", F.lit("status"), name, number), title=X.truncated(F.col("title"), TITLE_MOST),
        summary=X.truncated(F.col("update"), SUMMARY_MOST), source_url=page, source_published_at=T.source_date_time(F.col("i.created_at"), "UTC"), source_locale="ko-KR", confidence=1.0,
        priority=F.when(F.col("kind") == "MAINTENANCE", 75).when(F.col("i.incident_severity") == "critical", 85).otherwise(60), is_synthetic=synthetic,
        maintenance_type=F.when(F.col("kind") == "MAINTENANCE", "SCHEDULED"),
    )
    reason = F.when(F.col("i.id").isNull() | F.col("i.titles").isNull(), "unexpected shape").when(F.coalesce(F.col("title"), F.lit("")) == "", "no title in a known language")
    return _split(rows, F.array(made), reason)


# --- lists of events and notices


def _identity(prefix: str, link: Column, title: Column, first: Column) -> tuple[Column, Column]:
    """Key and slug hint: the number at the end of the link, else a fingerprint of what the item says."""
    number = X.trailing_number(link, "/")
    known = number.isNotNull()
    return F.concat_ws(":", F.lit(prefix), F.when(known, number).otherwise(I.fingerprint(title, first))), F.when(known, F.concat_ws("-", F.lit(prefix), number))


def _link_reason(link: Column, hosts: Column) -> Column:
    good = F.lower(link).rlike("^https?://") & X.host_allowed(link, hosts)
    return F.when(~F.coalesce(good, F.lit(False)), "link outside allowed hosts")


def event_list(raw: DataFrame, hosts: Column, game: str = "lostark", synthetic: bool = False) -> Normalized:
    """Lists of {Title, Link, StartDate, EndDate, RewardDate} in Korean time: an event each, and a reward where a deadline is
    stated (its end; it points to the event)."""
    rows = raw.select("document_key", F.posexplode(F.from_json("raw_text", "array<string>")).alias("position", "text"))
    rows = rows.withColumn("i", F.from_json("text", "Title string, Link string, StartDate string, EndDate string, RewardDate string"))
    rows = rows.withColumns({"link": F.trim("i.Link"), "title": X.single_line(X.plain_text(F.col("i.Title")))} | {n: T.source_date_time(F.col(f"i.{c}"), KST) for n, c in (("start", "StartDate"), ("end", "EndDate"), ("claim", "RewardDate"))})
    key, hint = _identity("event", F.col("link"), F.col("i.Title"), F.col("i.StartDate"))
    rows = rows.withColumns({"key": key, "hint": hint})
    stated = lambda n, c: F.when(F.col(n).isNotNull(), F.trim(f"i.{c}"))
    both = dict(game_id=game, source_url=F.col("link"), source_locale="ko-KR", confidence=1.0, is_synthetic=synthetic, start_at=F.col("start"), source_timezone=KST, region="kr", precision="DATETIME", start_at_source=stated("start", "StartDate"))
    event = candidate(kind="EVENT", source_key=F.col("key"), slug_hint=F.col("hint"), title=F.col("title"), end_at=F.col("end"), end_at_source=stated("end", "EndDate"), priority=50, **both)
    reward = candidate(kind="REWARD", source_key=F.concat("key", F.lit("#reward")), slug_hint=F.concat("hint", F.lit("-reward")), title=F.concat("title", F.lit(" 보상 수령")), end_at=F.col("claim"), end_at_source=stated("claim", "RewardDate"), priority=55, related_source_key=F.col("key"), **both)
    reason = F.when(F.col("i.Title").isNull() | F.col("i.Link").isNull(), "unexpected shape").otherwise(_link_reason(F.col("link"), hosts))
    return _split(rows, F.array(event, F.when(F.col("claim").isNotNull(), reward)), reason)


def typed_notices(raw: DataFrame, hosts: Column, game: str = "lostark", synthetic: bool = False) -> Normalized:
    """Lists of {Title, Date, Link, Type}: maintenance and announcements; other types are dropped without a warning."""
    rows = raw.select("document_key", F.posexplode(F.from_json("raw_text", "array<string>")).alias("position", "text"))
    rows = rows.withColumn("i", F.from_json("text", "Title string, Date string, Link string, Type string"))
    rows = rows.where(F.col("i.Title").isNull() | F.col("i.Type").isNull() | F.col("i.Type").isin("점검", "공지")).withColumns({"link": F.trim("i.Link"), "title": X.single_line(X.plain_text(F.col("i.Title")))})
    key, hint = _identity("notice", F.col("link"), F.col("i.Title"), F.col("i.Date"))
    work = F.col("i.Type") == "점검"
    made = candidate(
        kind=F.when(work, "MAINTENANCE").otherwise("ANNOUNCEMENT"), game_id=game, source_key=key, slug_hint=hint, title=F.col("title"), source_url=F.col("link"), source_locale="ko-KR", confidence=1.0,
        is_synthetic=synthetic, source_published_at=T.source_date_time(F.col("i.Date"), KST), priority=F.when(work, 75).otherwise(40), maintenance_type=F.when(work, X.maintenance_type(F.col("title"))),
    )
    reason = F.when(F.col("i.Title").isNull() | F.col("i.Link").isNull() | F.col("i.Type").isNull(), "unexpected shape").otherwise(_link_reason(F.col("link"), hosts))
    return _split(rows, F.array(made), reason)


#: Which list a resource has.
LIST_KEYS = {"event": "event_notice", "update": "update_notice", "notice": "notice"}


def keyed_notices(raw: DataFrame, hosts: Column, game: str = "maplestory", synthetic: bool = False) -> Normalized:
    """Documents whose key is event, update or notice, with their list under the resource's own name."""
    schema = ", ".join(f"{k} array<string>" for k in LIST_KEYS.values())
    lists = raw.select("document_key", F.from_json("raw_text", schema).alias("s"))
    own = F.coalesce(*[F.when(F.col("document_key") == n, F.col(f"s.{k}")) for n, k in LIST_KEYS.items()])
    rows = lists.select("document_key", F.posexplode(own).alias("position", "text"))
    rows = rows.withColumn("i", F.from_json("text", "title string, url string, notice_id bigint, date string, date_event_start string, date_event_end string"))
    rows = rows.withColumns({"link": F.trim("i.url"), "title": X.single_line(X.plain_text(F.col("i.title"))), "event": F.col("document_key") == "event"})
    rows = rows.withColumns({n: F.when(F.col("event"), T.source_date_time(F.col(f"i.date_event_{n}"), KST)) for n in ("start", "end")})
    number, work = F.col("i.notice_id").cast("string"), F.col("title").contains("점검")
    kind = F.when(F.col("event"), "EVENT").when(F.col("document_key") == "update", "UPDATE").when(work, "MAINTENANCE").otherwise("ANNOUNCEMENT")
    rows = rows.withColumn("kind", kind)
    is_ = lambda k: F.col("kind") == k
    made = candidate(
        kind=F.col("kind"), game_id=game, source_key=F.concat_ws(":", "document_key", number), slug_hint=F.concat_ws("-", "document_key", number), title=F.col("title"), start_at=F.col("start"), end_at=F.col("end"),
        source_timezone=F.when(F.col("event"), KST), start_at_source=F.when(F.col("start").isNotNull(), F.trim("i.date_event_start")), end_at_source=F.when(F.col("end").isNotNull(), F.trim("i.date_event_end")),
        region=F.when(F.col("event"), "kr"), precision=F.when(F.col("event"), "DATETIME"), source_url=F.col("link"), source_published_at=T.source_date_time(F.col("i.date"), KST), source_locale="ko-KR",
        priority=F.when(is_("EVENT"), 50).when(is_("UPDATE"), 65).when(is_("MAINTENANCE"), 75).otherwise(40), confidence=1.0, is_synthetic=synthetic,
        maintenance_type=F.when(is_("MAINTENANCE"), X.maintenance_type(F.col("title"))),
    )
    reason = F.when(F.col("i.title").isNull() | F.col("i.url").isNull() | F.col("i.notice_id").isNull(), "unexpected shape").otherwise(_link_reason(F.col("link"), hosts))
    return _split(rows, F.array(made), reason)


# --- snapshots of entities

#: The map that counts, and the keys of abilities by place.
MAP_ID, SLOTS = "11", ("Q", "W", "E", "R")


def champion_snapshot(raw: DataFrame) -> DataFrame:
    """version, id, name, stats and spells of each champion in whole snapshot files."""
    schema = "version string, data map<string,struct<id:string,name:string,stats:map<string,double>,spells:array<struct<name:string,cooldown:array<double>,cost:array<double>,range:array<double>>>>>"
    rows = raw.select(F.from_json("raw_text", schema).alias("f")).select("f.version", F.explode(F.map_values("f.data")).alias("c"))
    return rows.select("version", "c.*")


def item_snapshot(raw: DataFrame) -> DataFrame:
    """version, id, name, gold and stats of the items that can be bought on the map that counts."""
    schema = "version string, data map<string,struct<name:string,gold:struct<total:double,purchasable:boolean>,stats:map<string,double>,maps:map<string,boolean>>>"
    rows = raw.select(F.from_json("raw_text", schema).alias("f")).select("f.version", F.explode("f.data").alias("id", "i"))
    kept = rows.where((F.trim("i.name") != "") & F.col("i.gold.purchasable") & F.coalesce(F.element_at("i.maps", F.lit(MAP_ID)), F.lit(False)))
    return kept.select("version", "id", "i.name", F.col("i.gold.total").alias("gold"), F.coalesce("i.stats", F.create_map().cast("map<string,double>")).alias("stats"))
