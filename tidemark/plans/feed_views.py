"""Feed documents made of the driver's tables, in the shapes that real feeds have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .driver_views import read

HOSTS = ("game.example.com", "news.example.org")


def hosts():
    return F.array(*[F.lit(h) for h in HOSTS])


def _link():
    e = F.col("event_id")
    site = F.when(e % 5 == 0, "https://other.example.net").when(e % 2 == 0, "https://game.example.com").otherwise("https://www.news.example.org")
    return F.concat(site, F.lit("/views/"), e.cast("string"))


def _minute(c: str = "ts"):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:00")


def event_lists(spark: SparkSession, sf: str) -> DataFrame:
    """A list of one event for each row; every seventh has no end, every third a reward deadline, every 31st no title."""
    e = F.col("event_id")
    item = F.struct(
        F.when(e % 31 != 0, F.concat(F.lit("<b>"), "event_type", F.lit("</b> "), (F.col("user_id") % 40).cast("string"))).alias("Title"),
        _link().alias("Link"),
        _minute().alias("StartDate"),
        F.when(e % 7 != 0, F.date_format(F.col("ts") + F.expr("interval 2 day"), "yyyy-MM-dd'T'HH:mm:00")).otherwise("9999-12-31T00:00:00").alias("EndDate"),
        F.when(e % 3 == 0, F.date_format(F.col("ts") + F.expr("interval 5 day"), "yyyy-MM-dd'T'HH:mm:00")).alias("RewardDate"),
    )
    return read(spark, sf, "events").select(e.cast("string").alias("document_key"), F.to_json(F.array(item)).alias("raw_text"))


def notice_lists(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("점검", "공지", "기타")]), (e % 3 + 1).cast("int"))
    title = F.concat(F.when(e % 4 == 0, "긴급 ").when(e % 4 == 1, "연장 ").otherwise(""), F.lit("점검 "), e.cast("string"))
    item = F.struct(title.alias("Title"), _minute().alias("Date"), _link().alias("Link"), kind.alias("Type"))
    return read(spark, sf, "events").select(e.cast("string").alias("document_key"), F.to_json(F.array(item)).alias("raw_text"))


def keyed_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Documents event, update and notice by turns."""
    e = F.col("event_id")
    local = lambda c: F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm"), F.lit("+09:00"))
    item = F.struct(F.concat(F.when(e % 2 == 0, "정기점검 ").otherwise("안내 "), "event_type").alias("title"), _link().alias("url"), e.alias("notice_id"), local(F.col("ts")).alias("date"), F.when(e % 3 == 0, local(F.col("ts"))).alias("date_event_start"), F.when(e % 3 == 0, local(F.col("ts") + F.expr("interval 3 day"))).alias("date_event_end"))
    text = F.when(e % 3 == 0, F.to_json(F.struct(F.array(item).alias("event_notice")))).when(e % 3 == 1, F.to_json(F.struct(F.array(item).alias("update_notice")))).otherwise(F.to_json(F.struct(F.array(item).alias("notice"))))
    key = F.element_at(F.array(*[F.lit(k) for k in ("event", "update", "notice")]), (e % 3 + 1).cast("int"))
    return read(spark, sf, "events").select(key.alias("document_key"), text.alias("raw_text"))


def status_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A status document of one maintenance and one incident for each row."""
    e = F.col("event_id")
    entry = lambda locale, text: F.struct(F.lit(locale).alias("locale"), text.alias("content"))
    day = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:00'+00:00'")
    updates = F.array(
        F.struct(F.array(entry("en_US", F.concat(F.lit("old "), "event_type"))).alias("translations"), day.alias("created_at"), F.lit(None).cast("string").alias("updated_at")),
        F.struct(F.array(entry("en_US", F.concat(F.lit("new "), "event_type"))).alias("translations"), day.alias("created_at"), F.concat(F.lit("2025"), F.substring(day, 5, 30)).alias("updated_at")),
    )
    titles = F.when(e % 5 == 0, F.array(entry("ja_JP", F.lit("x")))).when(e % 2 == 0, F.array(entry("en_US", F.lit("work")), entry("ko_KR", F.lit("점검 <i>안내</i>")))).otherwise(F.array(entry("ko_KR", F.lit(" ")), entry("en_US", F.col("event_type"))))
    one = lambda number, state, severity: F.struct(number.alias("id"), F.lit(state).cast("string").alias("maintenance_status"), severity.alias("incident_severity"), titles.alias("titles"), updates.alias("updates"), day.alias("created_at"))
    severity = F.element_at(F.array(*[F.lit(k) for k in ("info", "warning", "critical")]), (e % 3 + 1).cast("int"))
    text = F.to_json(F.struct(F.array(one(e * 2, "scheduled", F.lit(None).cast("string"))).alias("maintenances"), F.array(one(e * 2 + 1, None, severity)).alias("incidents")))
    return read(spark, sf, "events").select(e.cast("string").alias("document_key"), text.alias("raw_text"))


def range_notices(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with a date range in the forms that notices use."""
    e = F.col("event_id")
    start = F.date_format("ts", "yyyy/MM/dd HH:mm")
    korean = F.date_format("ts", "yyyy'년 'M'월 'd'일 'HH:mm")
    later = F.col("ts") + F.expr("interval 3 day")
    label = F.element_at(F.array(*[F.lit(k) for k in (" (UTC+8)", " (한국 시간)", " (서버 시간)", " (somewhere)")]), (e % 4 + 1).cast("int"))
    text = (
        F.when(e % 6 == 0, F.lit("no range here"))
        .when(e % 6 == 1, F.concat(F.lit("점검 시간: "), korean, F.lit(" ~ "), F.lit("23:59")))
        .when(e % 6 == 2, F.concat(korean, F.lit(" ~ "), F.date_format(later, "yyyy'년 'M'월 'd'일 'HH:mm"), label))
        .otherwise(F.concat(F.lit("Period "), start, F.lit(" ~ "), F.date_format(later, "yyyy/MM/dd HH:mm"), label, F.lit(".")))
    )
    task = F.element_at(F.array(*[F.lit(k) for k in ("EVENT", "MAINTENANCE", "REWARD", "PATCH", "CLASSIFY")]), (e % 5 + 1).cast("int"))
    return read(spark, sf, "events").select(e.alias("number"), text.alias("text"), task.alias("task"), F.lit(None).cast("string").alias("title"), F.lit("Asia/Seoul").alias("default_zone"), F.lit("UTC+8").alias("server_zone"))


def champion_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as champions before and after a patch."""
    p = read(spark, sf, "part")
    k, price, size = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size").cast("double")
    spell = lambda low, high: F.struct(F.lit("bolt").alias("name"), F.array(low, high).alias("cooldown"), F.array(size).alias("cost"), F.array(F.lit(100.0)).alias("range"))

    def side(stat, low, high):
        return p.select(k.cast("string").alias("id"), F.col("p_name").alias("name"), F.create_map(F.lit("armor"), stat, F.lit("hp"), size).alias("stats"), F.array(spell(low, high)).alias("spells"), "p_partkey")

    previous = side(price, size + 1, size)
    current = side(F.when(k % 3 == 0, F.round(price + 1, 2)).when(k % 3 == 1, F.round(price - 1, 2)).otherwise(price), F.when(k % 4 == 0, size).otherwise(size + 1), F.when(k % 8 == 0, size + 2).otherwise(size))
    return previous.where("p_partkey % 10 <> 0").drop("p_partkey"), current.where("p_partkey % 10 <> 1").drop("p_partkey")


def item_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as items before and after: prices move, one statistic comes or goes."""
    p = read(spark, sf, "part")
    k, price, size = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size").cast("double")
    none = F.create_map().cast("map<string,double>")
    row = lambda gold, stats: p.select(k.cast("string").alias("id"), F.col("p_name").alias("name"), gold.alias("gold"), stats.alias("stats"), "p_partkey")
    previous = row(F.floor(price).cast("double"), F.when(k % 5 == 0, none).otherwise(F.create_map(F.lit("power"), size)))
    current = row(F.when(k % 3 == 0, F.floor(price) + 50).otherwise(F.floor(price)).cast("double"), F.when(k % 7 == 0, none).otherwise(F.create_map(F.lit("power"), size)))
    return previous.where("p_partkey % 10 <> 0").drop("p_partkey"), current.where("p_partkey % 10 <> 1").drop("p_partkey")
