"""De-duplication and publication of candidates as set operations.

A batch is decided as a whole, by joins, minima and one window. Keys that name the same fact stand in a defined order
(authority, source, key), which replaces arrival order; the candidates of a key stand in the order of their numbers, and each
of them gets its outcome. A key's record is found in three steps: its own record by source and key; the record that its
source has reported before, by provenance; the record of another source with the same meaning, the strongest first. A source
never supersedes or duplicates itself: two keys of one source are two records, whatever they say.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import session
from ..functions import model as M
from ..functions.identity import content_id, sha256, slug_with_suffix


def stronger(a: Column, b: Column) -> Column:
    """Whether source type ``a`` has more authority than ``b``; equal ones never supersede."""
    return M.authority(a) < M.authority(b)


KEY = ["source_id", "source_key"]
#: The order of a key's candidates; of equal numbers the hash decides.
ORDER = ("number", "content_hash", "decision")
STORE = ("source_id", "source_key", "source_type", "semantic_key", "content_hash", "status")


def twins(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """source_id, semantic_key and ``t``, the strongest stored record of that meaning that another source owns."""
    # the strongest record of each source and meaning, then the strongest source that is not the asking one: two records of
    # a meaning at most stay, so no meaning gathers rows
    best = F.struct(M.authority(F.col("source_type")).alias("authority"), "content_id", "source_id", "source_type", "status")
    each = stored.groupBy("semantic_key", "source_id").agg(F.min(best).alias("t")).select("semantic_key", "t")
    first = each.groupBy("semantic_key").agg(F.min("t").alias("first"))
    second = each.join(first, "semantic_key").where(F.col("t.source_id") != F.col("first.source_id")).groupBy("semantic_key").agg(F.min("t").alias("second"))
    asked = candidates.select("source_id", "semantic_key").distinct()
    both = asked.join(first.join(second, "semantic_key", "left"), "semantic_key")
    return both.select("source_id", "semantic_key", F.when(F.col("first.source_id") != F.col("source_id"), F.col("first")).otherwise(F.col("second")).alias("t"))


def _found(rows: DataFrame, stored: DataFrame | None, reported: DataFrame | None) -> DataFrame:
    """Candidates with ``own``, the record of their source and key; ``past``, the record of another source that they have
    reported before; and ``target``: the past one, or else the strongest record of another source with their meaning."""
    record = "struct<source_type:string,status:string,content_hash:string,content_id:string>"
    if stored is None:
        return rows.withColumns({x: F.lit(None).cast(record) for x in ("own", "past", "target")})
    kept = F.struct("source_type", "status", "content_hash", "content_id")
    found = rows.join(stored.select(*KEY, kept.alias("own")), KEY, "left")
    if reported is None:
        found = found.withColumn("past", F.lit(None).cast(record))
    else:
        owners = stored.select(F.col("source_id").alias("o"), "content_id", F.struct(M.authority(F.col("source_type")).alias("a"), kept.alias("r")).alias("x"))
        past = reported.select("content_id", *KEY).join(owners, "content_id").where(F.col("o") != F.col("source_id"))
        found = found.join(past.groupBy(*KEY).agg(F.min("x").alias("x")).select(*KEY, F.col("x.r").alias("past")), KEY, "left")
    t = twins(rows, stored).select("source_id", "semantic_key", F.when(F.col("t").isNotNull(), F.struct("t.source_type", "t.status", F.lit(None).cast("string").alias("content_hash"), "t.content_id")).alias("twin"))
    return found.join(t, ["source_id", "semantic_key"], "left").withColumn("target", F.coalesce("past", "twin")).drop("twin")


def _entries(found: DataFrame, stored: DataFrame | None) -> DataFrame:
    """How each key without a record of its own comes in: ``entry`` of ``at`` (where in the key's order), ``outcome`` and
    ``owner``. A key comes in by its first valid candidate that need not be held. Keys whose record is taken over are there too.

    Everything is a minimum that combines before the shuffle and a join by it, so a fact that many announce is no task's own."""
    held = F.col("held")
    at = F.struct(*ORDER)
    fields = F.struct("source_type", "semantic_key", "own_id", "target", F.col("past").isNull().alias("free"), at.alias("at"))
    entries = found.where(F.col("decision").isNotNull() & F.col("own").isNull() & ~held).groupBy(*KEY).agg(F.min_by(fields, at).alias("e")).select(*KEY, "e.*")
    over = stronger(F.col("source_type"), F.col("target.source_type"))
    may_own = F.col("free") & (F.col("target").isNull() | over)
    place = F.struct(M.authority(F.col("source_type")).alias("a"), F.col("source_id").alias("s"))
    entries = entries.withColumns({"over": over, "may_own": may_own, "place": place})
    claim = F.struct("place", "source_key", "own_id", F.coalesce("target.content_id", "own_id").alias("record"))
    leaders = entries.where("may_own").groupBy("semantic_key").agg(F.min(claim).alias("lead"))
    entries = entries.join(leaders, "semantic_key", "left")
    after = F.coalesce(F.col("free") & (F.col("lead.place") < F.col("place")) & (F.col("lead.place.s") != F.col("source_id")), F.lit(False))
    leads = F.coalesce(F.col("lead.own_id") == F.col("own_id"), F.lit(True))
    aim = F.when(~F.col("may_own") | leads, F.col("target.content_id"))
    outcome = F.when(after, "duplicate").when(aim.isNull(), "created").when(~F.col("over"), "duplicate").otherwise("updated")
    owner = F.when(after, F.col("lead.record")).otherwise(F.coalesce(aim, F.col("own_id")))
    decided = entries.select(*KEY, "place", "own_id", "at", outcome.alias("outcome"), owner.alias("owner"))
    if stored is None:
        return decided.select(*KEY, F.struct("at", "outcome", "owner").alias("entry"))
    # what would be held comes in all the same where another key of its source leads its meaning
    waiting = found.where(held & F.col("past").isNull()).groupBy(*KEY, "semantic_key").agg(F.min(at).alias("at"), F.first("source_type").alias("source_type"), F.first("own_id").alias("own_id"))
    early = waiting.join(leaders, "semantic_key").where((F.col("lead.place.s") == F.col("source_id")) & (F.col("lead.own_id") != F.col("own_id")))
    early = early.select(*KEY, place.alias("place"), "own_id", "at", F.lit("created").alias("outcome"), F.col("own_id").alias("owner"))
    fields = F.struct("place", "own_id", "at", "outcome", "owner")
    decided = session.written(decided.unionByName(early).groupBy(*KEY).agg(F.min_by(fields, "at").alias("e")).select(*KEY, "e.*"), "entries")
    # of several keys that take one record over the strongest gets it: those of its own source make records, others repeat it
    winners = decided.where("outcome = 'updated'").groupBy(F.col("owner").alias("record")).agg(F.min(F.struct("place", "source_key")).alias("won"))
    both = decided.join(winners, F.when(F.col("outcome") == "updated", F.col("owner")) == F.col("record"), "left")
    lost = F.coalesce(F.col("won") != F.struct("place", "source_key"), F.lit(False))
    again = lost & (F.col("won.place.s") == F.col("source_id"))
    settled = both.select(*KEY, F.struct("at", F.when(again, "created").when(lost, "duplicate").otherwise(F.col("outcome")).alias("outcome"), F.when(again, F.col("own_id")).otherwise(F.col("owner")).alias("owner")).alias("entry"))
    # a stronger source takes a record over before its weaker owner's own candidates come
    nowhere = F.lit(None).cast(decided.schema["at"].dataType)
    taken = stored.join(winners, stored["content_id"] == winners["record"]).select(*KEY, F.struct(nowhere.alias("at"), F.lit("duplicate").alias("outcome"), F.col("record").alias("owner")).alias("entry"))
    return settled.unionByName(taken)


def outcomes(candidates: DataFrame, stored: DataFrame | None = None, reported: DataFrame | None = None) -> DataFrame:
    """Every candidate (source_id, source_type, source_key, semantic_key, content_hash, decision, number) with ``outcome``:
    created, updated, unchanged, duplicate, review-held or rejected, and ``owner`` (content id of the fact, null if rejected).

    ``decision`` is PUBLISHED, PENDING_REVIEW or null (invalid). ``stored`` has source_id, source_key, source_type,
    semantic_key, content_hash, status, content_id; ``reported`` is provenance (content_id, source_id, source_key).

    The candidates of a key are versions of one announcement, in the order of their numbers: the first valid one brings the
    key in, each later one is held against what the record says by then. A published record is only changed by what may be
    published, so what it says is its last such version, or its last version at all while there is none; invalid candidates
    change nothing. A key that came in as a duplicate stays one. All sources see the store as it was before the batch. The
    first key of a meaning that may own it, by the order, makes those of other sources after it duplicates; only the first
    of several keys of that source supersedes a stored record, the others are created.
    """
    valid, published = F.col("decision").isNotNull(), F.col("decision") == "PUBLISHED"
    rows = candidates.withColumn("own_id", content_id(F.col("source_id"), F.col("source_key")))
    over = stronger(F.col("source_type"), F.col("target.source_type")) & (F.col("target.status") == "PUBLISHED")
    # several steps read what each candidate found; it is computed once
    found = session.written(_found(rows, stored, reported).withColumn("held", F.coalesce(valid & F.col("own").isNull() & over & ~published, F.lit(False))), "found")
    all_ = found.join(_entries(found, stored), KEY, "left")
    own, in_ = F.col("own").isNotNull(), F.coalesce(F.struct(*ORDER) >= F.col("entry.at"), F.lit(False))
    counts = valid & (own | in_)
    before = W.partitionBy(*KEY).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    said = lambda hash_, status: F.struct(hash_.alias("hash"), status.alias("status"))
    stands = said(F.col("own.content_hash"), F.col("own.status"))
    last_published = F.coalesce(F.last(F.when(counts & published, said(F.col("content_hash"), F.col("decision"))), ignorenulls=True).over(before), F.when(F.col("own.status") == "PUBLISHED", stands))
    last = F.coalesce(F.last(F.when(counts, said(F.col("content_hash"), F.col("decision"))), ignorenulls=True).over(before), F.when(own, stands))
    repeats = F.coalesce((F.col("entry.outcome") == "duplicate") & (own | in_), F.lit(False))
    state = F.col("state")
    outcome = (
        F.when(~valid, "rejected")
        .when(repeats, "duplicate")
        .when(~own & ~in_, "review-held")
        .when(state.isNull(), F.col("entry.outcome"))
        .when(state["hash"].eqNullSafe(F.col("content_hash")) & (state["status"] == F.col("decision")), "unchanged")
        .when((state["status"] == "PUBLISHED") & ~published, "review-held")
        .otherwise("updated")
    )
    owner = F.when(valid, F.when(~own & ~in_, F.col("target.content_id")).otherwise(F.coalesce("entry.owner", "own.content_id")))
    return all_.withColumn("state", F.coalesce(last_published, last)).withColumns({"outcome": outcome, "owner": owner}).drop("own", "past", "target", "held", "entry", "state", "own_id")


OUTCOMES = ("created", "updated", "unchanged", "duplicate", "review-held", "rejected")


def counters(decided: DataFrame) -> list[Column]:
    """What a run reports of its candidates: how many there are, of each outcome and, where it is known, of each validation."""
    named = [F.count_if(F.col("outcome") == o).alias(o.replace("-", "_")) for o in OUTCOMES]
    levels = [F.count_if(F.col("validation") == v).alias(v.lower()) for v in M.VALIDATION_STATUSES] if "validation" in decided.columns else []
    return [F.count(F.lit(1)).alias("discovered"), *named, *levels]


def merged(stored: DataFrame, decided: DataFrame) -> DataFrame:
    """The store after a batch: stored rows with what was updated, and what was created. Several candidates that update one
    record leave the strongest, then the latest. One full join by content id."""
    new = decided.where(F.col("outcome").isin("created", "updated")).withColumn("status", F.col("decision"))
    new = new.groupBy(F.col("owner").alias("content_id")).agg(F.min_by(F.struct(*STORE), F.struct(M.authority(F.col("source_type")), -F.col("number"))).alias("new"))
    both = stored.join(new, "content_id", "full_outer")
    return both.select("content_id", *[F.when(F.col("new").isNotNull(), F.col(f"new.{f}")).otherwise(F.col(f)).alias(f) for f in STORE])


def sighted(reported: DataFrame | None, decided: DataFrame, now: Column) -> DataFrame:
    """Provenance (content_id, source_id, source_key, role, first_seen, last_seen) after a batch: candidates that name a record
    are sightings of it; where another source has taken a record over, all that reported it before are SUPPORTING."""
    named = decided.where(F.col("outcome").isin("created", "updated", "unchanged", "duplicate"))
    fresh = named.groupBy(F.col("owner").alias("content_id"), "source_id", "source_key").agg(F.max(F.col("outcome") != "duplicate").alias("owns"))
    owned = fresh.where("owns").select("content_id", F.lit(True).alias("taken")).distinct()
    key = ["content_id", "source_id", "source_key"]
    before = (decided.sparkSession.createDataFrame([], "content_id string, source_id string, source_key string, role string, first_seen timestamp_ntz, last_seen timestamp_ntz") if reported is None else reported)
    both = before.join(fresh, key, "full_outer").join(owned, "content_id", "left")
    role = F.when(F.col("owns"), "PRIMARY").when(F.col("taken"), "SUPPORTING").otherwise(F.coalesce("role", F.lit("SUPPORTING")))
    return both.select(*key, role.alias("role"), F.coalesce("first_seen", now).alias("first_seen"), F.when(F.col("owns").isNotNull(), now).otherwise(F.col("last_seen")).alias("last_seen"))


def provenance(sightings: DataFrame) -> DataFrame:
    """One row for each (content_id, source_id, source_key): first and last sighting, how often, and the role: the
    strongest source is PRIMARY."""
    rolled = sightings.groupBy("content_id", "source_id", "source_key").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("sightings"), F.min("authority").alias("authority"))
    w = W.partitionBy("content_id").orderBy("authority", "first_seen", "source_id", "source_key")
    return rolled.withColumn("role", F.when(F.row_number().over(w) == 1, "PRIMARY").otherwise("SUPPORTING"))


def pruned(raw: DataFrame, cutoff: Column | datetime) -> DataFrame:
    """Raw documents without the texts of those fetched before a cutoff (strictly)."""
    return raw.withColumn("raw_text", F.when(F.col("fetched_at") >= cutoff, F.col("raw_text")))


def expired(content: DataFrame, ttl_days: dict[str, int], now: Column, seen: str = "last_seen") -> DataFrame:
    """Rows whose source has a time to live and that were not seen within it (strictly before)."""
    days = M.mapped(F.col("source_id"), ttl_days) if ttl_days else F.lit(None).cast("int")
    return content.where(F.col(seen) < now - F.make_dt_interval(days))


def sync(stored: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """key and action (created, updated, unchanged) of each wanted row; nothing is deleted."""
    both = wanted.select(key, F.col(value).alias("w")).join(stored.select(key, F.col(value).alias("s"), F.lit(True).alias("there")), key, "left")
    return both.select(key, F.when(F.col("there").isNull(), "created").when(F.col("w").eqNullSafe(F.col("s")), "unchanged").otherwise("updated").alias("action"))


def run_status(failed: Column, succeeded: Column) -> Column:
    return F.when(failed == 0, "SUCCEEDED").when(succeeded > 0, "PARTIAL").otherwise("FAILED")


def content_hash(*parts: Column) -> Column:
    """A hash of all that a candidate says; nulls count."""
    return sha256(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}))


def unique_slugs(content: DataFrame, slug: str = "slug", key: str = "id") -> DataFrame:
    """Slugs made unique: the first row of a slug keeps it, the others get a suffix from their key. The first is a minimum, so
    a slug that most rows have is no task's own."""
    firsts = content.groupBy(slug).agg(F.min(key).alias("_first"))
    rows = content.join(firsts.withColumnRenamed(slug, "_slug"), F.col(slug).eqNullSafe(F.col("_slug")))
    return rows.withColumn(slug, F.when(F.col(key).eqNullSafe(F.col("_first")), F.col(slug)).otherwise(slug_with_suffix(F.col(slug), F.col(key)))).drop("_slug", "_first")
