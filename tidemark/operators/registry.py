"""Small dimensions and rules of collection: games, sources, adapters, schedules, viewers, exports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model as M
from ..functions import times as T

FIXTURE_EVERY_MINUTES = 60
MOST_SELECTED, MOST_DISMISSED = 50, 500
LOCALES = ("ko-KR", "en-US", "ja-JP", "zh-TW")


@dataclass(frozen=True)
class Adapter:
    id: str
    game_id: str
    modes: tuple[str, ...]
    collector_status: str
    credentials: tuple[str, ...] = ()
    every_minutes: int | None = None


def adapters_table(spark: SparkSession, adapters: tuple[Adapter, ...]) -> DataFrame:
    rows = [(a.id, a.game_id, list(a.modes), a.collector_status, list(a.credentials), a.every_minutes) for a in adapters]
    return spark.createDataFrame(rows, "adapter_id string, game_id string, modes array<string>, collector_status string, credentials array<string>, every_minutes int")


def schedule(adapters: DataFrame, mode: str, configured: tuple[str, ...] = (), synthetic_allowed: bool = True) -> DataFrame:
    """adapter_id, every_minutes, and why an adapter is not scheduled: a code (null if it is) with what it is about. The
    checks come in this order, and the first that fails names the reason: REFUSED_MODE, UNSUPPORTED_MODE, NOT_ENABLED,
    MISSING_CREDENTIALS, NO_SCHEDULE. The last three ask about live collection, the very last about recorded one too."""
    missing = F.array_except("credentials", F.array(*[F.lit(c) for c in configured]).cast("array<string>"))
    live, none = F.lit(mode == "live"), F.lit(None).cast("string")
    checks = (
        (F.lit(mode != "live" and not synthetic_allowed), "REFUSED_MODE", F.lit(mode)),
        (~F.array_contains("modes", mode), "UNSUPPORTED_MODE", F.lit(mode)),
        (live & (F.col("collector_status") != "ENABLED"), "NOT_ENABLED", F.col("collector_status")),
        (live & (F.size(missing) > 0), "MISSING_CREDENTIALS", F.array_join(missing, ", ")),
        (F.lit(mode != "fixture") & F.col("every_minutes").isNull(), "NO_SCHEDULE", none),
    )
    failed = F.coalesce(*[F.when(bad, F.struct(F.lit(code).alias("reason"), about.alias("about"))) for bad, code, about in checks])
    every = F.lit(FIXTURE_EVERY_MINUTES) if mode == "fixture" else F.col("every_minutes")
    return adapters.withColumn("f", failed).select("adapter_id", "f.reason", "f.about", F.when(F.col("f").isNull(), every).alias("every_minutes"))


def last_by_id(*sources: DataFrame) -> DataFrame:
    """The union of source tables; where an id comes again the later table's row holds."""
    first, *rest = [s.withColumn("_n", F.lit(i)) for i, s in enumerate(sources)]
    for s in rest:
        first = first.unionByName(s, allowMissingColumns=True)
    fields = [c for c in first.columns if c not in ("_n", "id")]
    return first.groupBy("id").agg(F.max_by(F.struct(*fields), "_n").alias("s")).select("id", "s.*")


def twins(sources: DataFrame, prefix: str, source_type: str = "FIXTURE") -> DataFrame:
    """Sources that stand in for others in development: their own ids, another type, no credentials."""
    return sources.withColumns({"id": F.concat(F.lit(prefix), "id"), "type": F.lit(source_type), "is_official": F.lit(False), "authentication": F.lit("none")})


def by_type_rank(sources: DataFrame) -> DataFrame:
    """Real sources of each game, strongest type first."""
    return sources.where("type <> 'FIXTURE'").orderBy("game_id", M.authority(F.col("type")), "id")


@dataclass(frozen=True)
class Viewer:
    """Defaults for what a viewer has not chosen."""

    timezone: str = "Asia/Seoul"
    locale: str = "ko-KR"
    games: tuple[str, ...] = field(default=M.GAMES)


def preferences(rows: DataFrame, defaults: Viewer = Viewer()) -> DataFrame:
    """Stored preferences made good: known games once each, the last dismissed ids, a known zone and language."""
    empty = F.array().cast("array<string>")
    games = F.filter(F.array_distinct(F.coalesce("selected", empty)), lambda g: g.isin(*defaults.games))
    gone = F.filter(F.coalesce("dismissed", empty), lambda d: d.isNotNull())
    last = F.slice(gone, F.greatest(F.size(gone) - (MOST_DISMISSED - 1), F.lit(1)), F.lit(MOST_DISMISSED))
    return rows.withColumns(
        {
            "selected": F.slice(games, 1, MOST_SELECTED),
            "dismissed": last,
            "timezone": F.when(T.normal_zone(F.col("timezone")).isNotNull(), F.col("timezone")).otherwise(defaults.timezone),
            "locale": F.when(F.col("locale").isin(*LOCALES), F.col("locale")).otherwise(defaults.locale),
        }
    )


def effective_games(selected: Column, defaults: tuple[str, ...] = M.GAMES) -> Column:
    return F.when(F.size(selected) > 0, selected).otherwise(F.array(*[F.lit(g) for g in defaults]))


def health(ok: Column) -> Column:
    """HEALTHY, DEGRADED or UNHEALTHY of a group of checks; an aggregate."""
    failed = F.count_if(~ok)
    return F.when(failed == 0, "HEALTHY").when(failed == F.count("*"), "UNHEALTHY").otherwise("DEGRADED")


def sitemap(content: DataFrame, pages: DataFrame, base: str) -> DataFrame:
    """url, last_modified, frequency and priority of fixed pages (path, frequency, priority) and of real content (href,
    updated_at, is_synthetic)."""
    fixed = pages.select(F.concat(F.lit(base), "path").alias("url"), F.lit(None).cast("timestamp_ntz").alias("last_modified"), "frequency", F.col("priority").cast("double").alias("priority"))
    records = content.where(~F.col("is_synthetic")).select(F.concat(F.lit(base), "href").alias("url"), F.col("updated_at").alias("last_modified"), F.lit("daily").alias("frequency"), F.lit(0.5).alias("priority"))
    return fixed.unionByName(records)


def json_ld(kind: str, **fields: Column) -> Column:
    """A JSON-LD object that is safe inside a page."""
    head = {"@context": F.lit("https://schema.org"), "@type": F.lit(kind)}
    return F.replace(F.to_json(F.struct(*[c.alias(n) for n, c in {**head, **fields}.items()])), F.lit("<"), F.lit("\\u003c"))


# --- rules of collection


def retryable(status: Column) -> Column:
    return status.isin(408, 425, 429, 500, 502, 503, 504)


#: What pages of protection services say.
CHALLENGE_MARKS = ("captcha", "cf-chl-", "challenge-platform", "attention required", "access denied by security policy")
CHALLENGE_STATUSES = (403, 429, 503)
#: Characters of a page in which a mark counts.
CHALLENGE_HEAD = 5000


def challenged(status: Column, mitigated: Column, body: Column) -> Column:
    """Whether an answer is a protection page."""
    head = F.lower(F.substring(body, 1, CHALLENGE_HEAD))
    marked = F.exists(F.array(*[F.lit(m) for m in CHALLENGE_MARKS]), lambda m: F.contains(head, m))
    return status.isin(*CHALLENGE_STATUSES) & (F.coalesce(mitigated == "challenge", F.lit(False)) | F.coalesce(marked, F.lit(False)))


_HTTP_DATE = "EEE, dd MMM yyyy HH:mm:ss zzz"


def http_date(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, ", ""), F.lit(_HTTP_DATE.removeprefix("EEE, "))).cast("timestamp_ntz")


def retry_after(value: Column, now: Column) -> Column:
    """Milliseconds to wait: from seconds or a date, at least 0; null if neither."""
    seconds = F.trim(value).try_cast("double")
    until = F.unix_millis(http_date(value).cast("timestamp")) - F.unix_millis(now.cast("timestamp"))
    wait = F.coalesce(F.round(seconds * 1000).cast("long"), until)
    return F.when(wait.isNotNull(), F.greatest(wait, F.lit(0).cast("long")))


def rate_limit_reset(value: Column, now: Column) -> Column:
    """Epoch milliseconds: from epoch milliseconds or seconds, seconds from now, or a date."""
    n = F.trim(value).try_cast("double")
    at = F.when(n > 1e12, n).when(n > 1e9, n * 1000).otherwise(F.unix_millis(now.cast("timestamp")) + n * 1000)
    return F.coalesce(F.round(at).cast("long"), F.unix_millis(http_date(value).cast("timestamp")))


def backoff_ceiling(attempt: Column, base_ms: int = 500, most_ms: int = 30_000) -> Column:
    return F.least(F.lit(most_ms).cast("double"), base_ms * F.pow(F.lit(2.0), attempt)).cast("long")


def abandoned(runs: DataFrame, now: Column, stale_minutes: int = 30) -> DataFrame:
    """Runs with ``status`` ABANDONED where they have been RUNNING for longer than allowed."""
    late = (F.col("status") == "RUNNING") & (now - F.col("started_at") > F.expr(f"make_dt_interval(0, 0, {stale_minutes})"))
    return runs.withColumn("status", F.when(late, "ABANDONED").otherwise(F.col("status")))
