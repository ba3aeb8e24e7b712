"""Validation of candidates as one column: an array of issues, each with code, severity and field.

A row without issues has an empty array; the worst severity decides its status. Rows whose shape is bad get only that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import model as M
from ..functions import state as S
from ..functions import times as T
from ..functions.text import for_match, host_allowed, once

ISSUE = "array<struct<code:string,severity:string,field:string>>"


@dataclass(frozen=True)
class Limits:
    range_most = M.RANGE_MOST
    start_most = M.START_MOST
    quantity_most = M.QUANTITY_MOST


def issue(when: Column, code: str, severity: str, field: str | None = None) -> Column:
    one = F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).cast("string").alias("field"))
    return F.when(when, one)


def gathered(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues)).cast(ISSUE)


#: Bounds of a candidate's texts and numbers, and the fields that some kinds must have.
TEXT_BOUNDS = {"title": (1, 200), "source_key": (1, 300), "summary": (1, 600), "slug_hint": (1, 80), "game_id": (1, 40)}
NUMBER_BOUNDS = {"priority": (0, 100), "confidence": (0, 1)}
NEEDED = ("kind", "game_id", "source_key", "title", "source_url", "priority", "confidence")
OF_KIND = {"PATCH": "version", "REDEEM_CODE": "code", "MAINTENANCE": "maintenance_type"}
MAINTENANCE_TYPES = ("SCHEDULED", "EMERGENCY", "EXTENDED")
PRECISIONS = ("DATETIME", "DATE")
CODE = "^[A-Za-z0-9][A-Za-z0-9-]{3,39}$"


def shape(candidate: Column) -> Column:
    """Issues of the form of a candidate (a struct of ``sources.feeds.CANDIDATE``), one for each bad field: what is missing,
    not of the known values, out of bounds, no http address, or not there for its kind."""
    c = candidate
    bad = {n: c[n].isNull() for n in NEEDED}

    def also(name: str, when: Column) -> None:
        bad[name] = bad.get(name, F.lit(False)) | F.coalesce(when, F.lit(False))

    for name, (low, high) in TEXT_BOUNDS.items():
        also(name, ~F.length(F.trim(c[name])).between(low, high))
    for name, (low, high) in NUMBER_BOUNDS.items():
        also(name, ~c[name].between(low, high))
    for name, known in (("kind", M.CONTENT_TYPES), ("maintenance_type", MAINTENANCE_TYPES), ("precision", PRECISIONS)):
        also(name, ~c[name].isin(*known))
    also("source_url", ~c["source_url"].rlike("^https?://[^/\\s]+"))
    also("code", ~c["code"].rlike(CODE))
    for kind, name in OF_KIND.items():
        also(name, (c["kind"] == kind) & c[name].isNull())
    return gathered(*[issue(when, "SCHEMA", "INVALID", name) for name, when in bad.items()])


def source(game: Column, source_game: Column, kind: Column, kinds: Column, url: Column, hosts: Column) -> Column:
    allowed = host_allowed(url, hosts)
    return gathered(
        issue(game != source_game, "SOURCE_GAME_MISMATCH", "INVALID", "gameId"),
        issue(~F.array_contains(kinds, kind), "UNEXPECTED_CONTENT_TYPE", "REVIEW", "kind"),
        issue(~allowed, "SOURCE_URL_HOST", "REVIEW", "sourceUrl"),
        issue(allowed & url.startswith("http:"), "SOURCE_URL_INSECURE", "WARNING", "sourceUrl"),
    )


def dates(kind: Column, start: Column, end: Column, now: Column, limits: Limits = Limits()) -> Column:
    """An end before the start stops the other checks."""
    upside_down = F.coalesce(end < start, F.lit(False))
    usual = gathered(
        issue(end - start > S.span(limits.range_most), "RANGE_TOO_LONG", "REVIEW", "endAt"),
        issue(start - now > S.span(limits.start_most), "START_TOO_FAR", "REVIEW", "startAt"),
        issue(end < now, "ALREADY_ENDED", "WARNING", "endAt"),
        issue(kind.isin("EVENT", "BANNER", "REWARD", "REDEEM_CODE") & end.isNull(), "END_MISSING", "WARNING", "endAt"),
        issue((kind == "MAINTENANCE") & start.isNull(), "START_MISSING", "WARNING", "startAt"),
    )
    return F.when(upside_down, gathered(issue(F.lit(True), "END_BEFORE_START", "INVALID", "endAt"))).otherwise(usual)


def timing(zone: Column, precision: Column, start_text: Column, start: Column, end_text: Column, end: Column) -> Column:
    """A stated zone has to exist, and a local time that the source states has to be, in that zone, the instant made of it."""
    normal = T.normal_zone(zone)

    def wrong(text: Column, at: Column) -> Column:
        return normal.isNotNull() & (F.coalesce(precision, F.lit("DATETIME")) != "DATE") & (T.to_instant(T.source_wall_time(text), normal) != at)

    return gathered(
        issue(zone.isNotNull() & normal.isNull(), "TIMEZONE_UNKNOWN", "WARNING", "timing.sourceTimezone"),
        issue(wrong(start_text, start), "TIMEZONE_MISMATCH", "INVALID", "startAt"),
        issue(wrong(end_text, end), "TIMEZONE_MISMATCH", "INVALID", "endAt"),
    )


def quantities(items: Column, limits: Limits = Limits()) -> Column:
    """One issue for each implausible amount of an array of structs with ``quantity``."""
    bad = F.filter(items, lambda x: x["quantity"] > limits.quantity_most)
    return F.transform(bad, lambda _: F.struct(F.lit("REWARD_QUANTITY_IMPLAUSIBLE").alias("code"), F.lit("REVIEW").alias("severity"), F.lit("items").alias("field"))).cast(ISSUE)


def patch_change(change: Column, field: Column, before: Column, after: Column, description: Column) -> Column:
    half = before.isNull() != after.isNull()
    return gathered(
        issue(before.isNotNull() & (before == after), "PATCH_VALUE_UNCHANGED", "WARNING", "changes"),
        issue(half & ~change.isin("NEW", "REMOVED"), "PATCH_VALUE_HALF_PAIR", "WARNING", "changes"),
        issue(field.isNotNull() & before.isNull() & after.isNull() & description.isNull(), "PATCH_CHANGE_EMPTY", "WARNING", "changes"),
    )


def synthetic(source_type: Column, is_synthetic: Column, code: Column) -> Column:
    fixture = source_type == "FIXTURE"
    return gathered(
        issue(fixture & ~is_synthetic, "FIXTURE_NOT_SYNTHETIC", "INVALID", "isSynthetic"),
        issue(~fixture & is_synthetic, "SYNTHETIC_FROM_REAL_SOURCE", "INVALID", "isSynthetic"),
        issue(is_synthetic & code.isNotNull() & ~F.upper(code).startswith(M.SYNTHETIC_CODE_PREFIX), "SYNTHETIC_CODE_UNMARKED", "INVALID", "code"),
    )


def evidence(parser: Column, excerpts: Column, kind: Column, code: Column, is_synthetic: Column, start: Column, end: Column, document: Column) -> Column:
    """``excerpts``: array<struct<field, excerpt>>; ``document``: the source's text. A real code needs an excerpt that has it.
    What a model read needs excerpts, one for each date, and every excerpt has to stand in the source: an issue for each."""
    none = F.size(excerpts) == 0
    read = (parser == "ai") & ~none
    backed = lambda name: F.exists(excerpts, lambda e: F.substring_index(e["field"], ".", 1) == name)
    text = for_match(document)
    one = lambda e: F.struct(F.lit("EVIDENCE_NOT_IN_SOURCE").alias("code"), F.lit("REVIEW").alias("severity"), e["field"].alias("field"))
    # the text is normalised once, then asked for each excerpt
    lost = once(F.when(read, text), lambda t: F.transform(F.filter(excerpts, lambda e: ~F.contains(t, for_match(e["excerpt"]))), one))
    fixed = gathered(
        issue((kind == "REDEEM_CODE") & ~is_synthetic & ~F.exists(excerpts, lambda e: F.contains(for_match(e["excerpt"]), F.lower(code))), "CODE_WITHOUT_EVIDENCE", "REVIEW", "redeemCode.code"),
        issue((parser == "ai") & none, "AI_WITHOUT_EVIDENCE", "REVIEW"),
        issue(read & start.isNotNull() & ~backed("startAt"), "AI_FIELD_WITHOUT_EVIDENCE", "REVIEW", "startAt"),
        issue(read & end.isNotNull() & ~backed("endAt"), "AI_FIELD_WITHOUT_EVIDENCE", "REVIEW", "endAt"),
    )
    return F.concat(fixed, F.coalesce(lost, F.array()).cast(ISSUE))


def candidate_issues(c: Column, excerpts: Column, parser: Column, document: Column, source_game: Column, source_type: Column, kinds: Column, hosts: Column, now: Column) -> Column:
    """All issues of a candidate (a struct of ``sources.feeds.CANDIDATE``): those of its form alone if it has any."""
    form = shape(c)
    rest = F.concat(
        source(c["game_id"], source_game, c["kind"], kinds, c["source_url"], hosts),
        dates(c["kind"], c["start_at"], c["end_at"], now),
        timing(c["source_timezone"], c["precision"], c["start_at_source"], c["start_at"], c["end_at_source"], c["end_at"]),
        synthetic(source_type, c["is_synthetic"], c["code"]),
        evidence(parser, excerpts, c["kind"], c["code"], c["is_synthetic"], c["start_at"], c["end_at"], document),
    )
    return once(form, lambda f: F.when(F.size(f) > 0, f).otherwise(rest))


def worst(issues: Column) -> Column:
    """Status of a list of issues."""
    rank = F.aggregate(issues, F.lit(0), lambda a, i: F.greatest(a, M.severity(i["severity"])))
    return F.element_at(F.array(*[F.lit(s) for s in M.VALIDATION_STATUSES]), rank + 1)


#: Raise it with every change of a rule.
VERSION = "3"


def results(rows: DataFrame, run: str, now: Column) -> DataFrame:
    """Validation results of a run, as they are appended to those of earlier runs: a row for each candidate (c, number, issues)."""
    return rows.select(F.col("c")["source_key"].alias("candidate_key"), "source_id", "number", worst(F.col("issues")).alias("status"), "issues", F.lit(run).alias("ingestion_run_id"), F.lit(VERSION).alias("validator_version"), now.alias("created_at"))
