"""Tables of the store as set operations: raw documents, runs, children, sources, expiry.

Each function takes the table as it stands and what has come, and gives the table as it is afterwards; a caller writes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .places import numbered
from .publish import expired

RAW_KEY = ["source_id", "document_key", "content_hash"]


def upserted_raw(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Raw documents (RAW_KEY, raw_text, first_seen, last_checked) after fetches (RAW_KEY, raw_text, fetched_at): a version
    that is known is only checked again, another is new. ``action`` says which: kept, checked or inserted."""
    new = fetched.groupBy(*RAW_KEY).agg(F.min("raw_text").alias("new_text"), F.min("fetched_at").alias("first_at"), F.max("fetched_at").alias("at"))
    both = stored.join(new, RAW_KEY, "full_outer")
    known, came = F.col("first_seen").isNotNull(), F.col("at").isNotNull()
    return both.select(*RAW_KEY, F.when(known, F.col("raw_text")).otherwise(F.col("new_text")).alias("raw_text"), F.coalesce("first_seen", "first_at").alias("first_seen"), F.greatest("last_checked", "at").alias("last_checked"), F.when(known & came, "checked").when(known, "kept").otherwise("inserted").alias("action"))


def touched_raw(stored: DataFrame, unchanged: DataFrame) -> DataFrame:
    """Raw documents whose source has answered that nothing changed (source_id, document_key, fetched_at): their latest
    version is checked again."""
    at = unchanged.groupBy("source_id", "document_key").agg(F.max("fetched_at").alias("at"))
    newest = F.max(F.struct("last_checked", "content_hash")).over(W.partitionBy("source_id", "document_key"))
    rows = stored.withColumn("newest", newest).join(at, ["source_id", "document_key"], "left")
    checked = F.when(F.col("content_hash") == F.col("newest.content_hash"), F.greatest("last_checked", "at")).otherwise(F.col("last_checked"))
    return rows.withColumn("last_checked", checked).drop("newest", "at")


def finished_runs(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Runs (run_id, status, finished_at, ...) with what reports of the same columns say of them."""
    new = reports.select("run_id", F.col("status").alias("s"), F.col("finished_at").alias("f"))
    return runs.join(new, "run_id", "left").withColumns({"status": F.coalesce("s", "status"), "finished_at": F.coalesce("f", "finished_at")}).drop("s", "f")


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    """The last ``n`` runs: a top-k report."""
    return runs.orderBy(F.desc("started_at"), "run_id").limit(n)


def replaced_children(stored: DataFrame, new: DataFrame, parents: DataFrame) -> DataFrame:
    """Children (content_id, position, ...) after ``parents`` (content_id) have been written anew with ``new``; those of other
    parents stay."""
    return stored.join(parents.select("content_id").distinct(), "content_id", "left_anti").unionByName(new)


def with_source(content: DataFrame, sources: DataFrame) -> DataFrame:
    """Content with name, type and address of its source; content of unknown sources is left out. Sources are a dimension:
    Spark sends them to the tasks while they are small by its own measure."""
    return content.join(sources.select("source_id", F.col("name").alias("source_name"), F.col("type").alias("source_type"), F.col("url").alias("source_page")), "source_id")


def reported_by(reported: DataFrame, sources: DataFrame) -> DataFrame:
    """Provenance with the names of its sources, the primary one first, then by first sighting."""
    named = reported.join(sources.select("source_id", "name"), "source_id")
    order = W.partitionBy("content_id").orderBy(F.col("role") != "PRIMARY", "first_seen", "source_id", "source_key")
    return named.withColumn("place", F.row_number().over(order))


def swept(content: DataFrame, children: DataFrame, raw: DataFrame, parses: DataFrame, ttl_days: dict[str, int], now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """What stays of content (content_id, source_id, last_seen), its children (content_id), raw documents (raw_id, source_id,
    last_checked) and their parse results (raw_id), and a report: of each source with a time to live, what went.

    A record goes with its children, a raw document with its results. Sources without a time to live keep everything.
    """
    gone = expired(content, ttl_days, now).select("content_id", "source_id")
    old = expired(raw, ttl_days, now, "last_checked").select("raw_id", "source_id")
    count = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    sources = content.sparkSession.createDataFrame([(s,) for s in ttl_days], "source_id string")
    results = parses.join(old, "raw_id")
    report = sources.join(count(gone, "content"), "source_id", "left").join(count(old, "raw_documents"), "source_id", "left").join(count(results, "parse_results"), "source_id", "left").na.fill(0)
    by_content, by_raw = gone.select("content_id"), old.select("raw_id")
    return content.join(by_content, "content_id", "left_anti"), children.join(by_content, "content_id", "left_anti"), raw.join(by_raw, "raw_id", "left_anti"), parses.join(by_raw, "raw_id", "left_anti"), report


def version_pairs(versions: DataFrame) -> DataFrame:
    """version and the one before it of a published list (version, position: from the newest on, no two alike). Versions are
    numbered by ranges and meet their neighbour by number, so no task takes the whole list."""
    placed = numbered(versions.select("version", "position"), [], [F.col("position")])
    before = placed.select(F.col("version").alias("previous"), (F.col("place") - 1).alias("place"))
    return placed.join(before, "place", "left").select("version", "previous")
