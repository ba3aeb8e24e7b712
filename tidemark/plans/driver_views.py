"""A fixed projection of the driver's tables onto the content model, so that every operator has rows to run on.

Spark expressions here and SQL in ``oracles.py`` say the same thing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model as M
from ..functions import recurrence as R
from ..functions.state import instant
from ..sources.feeds import candidate

#: The instant at which all time-dependent queries stand.
NOW = "2024-01-16 00:00:00"


def now() -> Column:
    return instant(NOW)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _element(index: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(index, F.lit(len(names))) + 1).cast("int"))


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content items from ``events``."""
    e, ts = F.col("event_id"), F.col("ts")
    source = _element(e, M.SOURCE_TYPES)
    return read(spark, sf_dir, "events").select(
        e.cast("string").alias("id"),
        e.alias("number"),
        e.cast("string").alias("source_key"),
        _element(F.col("user_id"), M.GAMES).alias("game_id"),
        _element(e, M.CONTENT_TYPES).alias("type"),
        F.concat_ws(" ", "event_type", (F.col("user_id") % 40).cast("string")).alias("title"),
        F.when(e % 13 != 0, ts).alias("start_at"),
        F.when(e % 7 != 0, ts + _hours(F.floor("value"))).alias("end_at"),
        F.when(e % 5 != 0, ts - _hours(e % 72)).alias("source_published_at"),
        ts.alias("published_at"),
        ts.alias("updated_at"),
        (e % 101).cast("int").alias("priority"),
        F.when(e % 11 == 0, "PENDING_REVIEW").otherwise("PUBLISHED").alias("status"),
        (e % 3 == 0).alias("is_synthetic"),
        source.alias("source_type"),
        M.authority(source).alias("authority"),
    )


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).where("status = 'PUBLISHED'")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fetches of each document: the same key an hour apart, the later one changed for every tenth."""
    d = read(spark, sf_dir, "documents")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    fetch = F.explode(F.array(F.lit(0), F.lit(1))).alias("fetch")
    rows = d.select("doc_id", "source", "text", fetch)
    text = F.when((F.col("fetch") == 1) & (F.col("doc_id") % 10 == 0), F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return rows.select(
        F.col("source").alias("source_id"),
        F.col("doc_id").cast("string").alias("document_key"),
        F.sha2(text, 256).alias("content_hash"),
        (base + F.make_dt_interval(F.lit(0), (F.col("doc_id") % 1000).cast("int") + F.col("fetch"))).alias("fetched_at"),
        text.alias("raw_text"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming candidates from ``events``: thirty titles a day and game, so that sources announce the same things."""
    e = F.col("event_id")
    source = _element(e, M.SOURCE_TYPES)
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("src-"), M.authority(source).cast("string")).alias("source_id"),
        source.alias("source_type"),
        (F.pmod(e, F.lit(997))).cast("string").alias("source_key"),
        _element(F.col("user_id"), M.GAMES).alias("game_id"),
        _element(e, M.CONTENT_TYPES).alias("kind"),
        F.concat_ws(" ", "event_type", (F.col("user_id") % 30).cast("string")).alias("title"),
        F.col("ts").alias("start_at"),
        (F.col("ts") + _hours(F.floor("value") - 5)).alias("end_at"),
        e.alias("number"),
        F.col("value"),
        (e % 3 == 0).alias("is_synthetic"),
        F.when(e % 9 == 0, "http:").otherwise("https:").alias("scheme"),
    )


PARSERS = ("deterministic", "ai", "manual", "fixture")
HOSTS = ("example.com", "news.example.org")


def checked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole candidates from ``events`` with what their validation asks for: ``c`` (the candidate), source_id, source_type,
    source_game, number, parser, excerpts and document. Now and then a field is bad, in ways that differ by number."""
    e = F.col("event_id")
    source = _element(e, M.SOURCE_TYPES)
    n, start = e.cast("string"), F.date_trunc("minute", "ts").cast("timestamp_ntz")
    game, kind = _element(F.col("user_id"), M.GAMES), _element(e, M.CONTENT_TYPES)
    stated = F.when(e % 5 == 0, F.date_format(start + F.when(e % 15 == 0, _hours(F.lit(0))).otherwise(_hours(F.lit(9))), "yyyy/MM/dd HH:mm"))
    site = F.when(e % 13 == 0, "://example.com.evil.test").when(e % 2 == 0, "://www.example.com").otherwise("://news.example.org")
    code = F.when((kind == "REDEEM_CODE") & (e % 113 != 0), F.concat(F.when((source == "FIXTURE") & (e % 3 != 1), "GPTEST-").otherwise("CODE"), (e % 50).cast("string")))
    c = candidate(
        kind=kind, game_id=game, source_key=(e % 997).cast("string"), title=F.when(e % 101 != 0, F.concat(F.lit("["), F.col("event_type"), F.lit("] ＴＩＴＬＥ "), (F.col("user_id") % 3).cast("string"))).otherwise(" "),
        start_at=start, end_at=start + _hours(F.floor("value") - 5), source_timezone=F.when(e % 5 == 0, "Asia/Seoul").when(e % 5 == 1, "Mars/Base"), start_at_source=stated,
        precision=F.when(e % 10 == 0, "DATE").when(e % 5 < 2, "DATETIME"), source_url=F.when(e % 103 == 0, "ftp").otherwise(F.concat(F.when(e % 9 == 0, "http").otherwise("https"), site, F.lit("/n/"), n)),
        priority=F.when(e % 107 == 0, 200).otherwise(50), confidence=1.0, is_synthetic=(source == "FIXTURE") != (e % 109 == 0), code=code,
        maintenance_type=F.when(kind == "MAINTENANCE", "SCHEDULED"), version=F.when(kind == "PATCH", F.concat(F.lit("1."), (e % 40).cast("string"))),
    )
    said = F.coalesce(code, F.lit("none"))
    quote = lambda field, text: F.struct(F.lit(field).alias("field"), text.alias("excerpt"))
    two = F.array(quote("startAt", F.concat(F.lit("Starts "), "event_type")), quote("redeemCode.code", F.concat(F.lit("use "), said)))
    excerpts = F.when(e % 3 == 0, F.slice(two, 1, 0)).when(e % 3 == 1, two).otherwise(F.concat(two, F.array(quote("endAt", F.concat(F.lit("gone "), n)))))
    document = F.when(e % 7 != 0, F.concat(F.lit("Ｓtarts \n  "), "event_type", F.lit(". Use "), said))
    return read(spark, sf_dir, "events").select(
        c.alias("c"),
        F.concat(F.lit("src-"), M.authority(source).cast("string")).alias("source_id"),
        source.alias("source_type"),
        F.when(e % 29 == 0, "lol").otherwise(game).alias("source_game"),
        e.alias("number"),
        _element(e, PARSERS).alias("parser"),
        excerpts.alias("excerpts"),
        document.alias("document"),
    )


def reset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual rules, and one of each supplier: daily, weekly or monthly by turns."""
    k, none = F.col("s_suppkey"), lambda kind: F.lit(None).cast(kind)
    freq = _element(k, ("DAILY", "WEEKLY", "MONTHLY"))
    weekday = F.struct((k % 7 + 1).cast("int").alias("weekday"), none("int").alias("nth"))
    own = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), _element(k, M.GAMES).alias("game_id"), F.col("s_name").alias("name"), freq.alias("frequency"), F.lit("Asia/Seoul").alias("zone"),
        F.lit(False).alias("is_primary"), F.lit(True).alias("is_active"), freq.alias("freq"), F.lit(1).alias("interval"), F.array((k % 24 * 60).cast("int")).alias("times"),
        F.filter(F.array(weekday), lambda _: freq == "WEEKLY").alias("weekdays"), F.filter(F.array((k % 28 + 1).cast("int")), lambda _: freq == "MONTHLY").alias("month_days"),
        none("date").alias("anchor"), none("timestamp_ntz").alias("until"), F.when(freq == "DAILY", 2).when(freq == "WEEKLY", 8).otherwise(125).alias("horizon"),
    )
    return R.rules_table(spark).unionByName(own)


def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a patch: line items with the price before and after their discount."""
    line = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    # both sides grow with the data; their key is the same, so one shuffle of each serves the join and the grouping
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("l_orderkey").alias("patch_id"),
        F.col("l_linenumber").alias("position"),
        F.col("l_returnflag").alias("target_type"),
        F.col("l_extendedprice").alias("before"),
        F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("after"),
        "o_orderpriority",
        "o_orderdate",
    )


def part_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Previous and current snapshot of parts."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    k = F.col("p_partkey")
    previous = p.where(k % 10 != 0)
    current = p.where(k % 10 != 1).withColumn("p_retailprice", F.when(k % 3 == 0, F.round(F.col("p_retailprice") + 1, 2)).otherwise(F.col("p_retailprice"))).withColumn("p_size", F.when(k % 7 == 0, F.col("p_size") - 1).otherwise(F.col("p_size")))
    return previous, current
