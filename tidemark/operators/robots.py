"""Robots files: their rules as rows, and which addresses a crawler may read.

Files are parsed with functions of columns, one row for each rule, so any number of hosts is one job. An answer that is no
file decides for its whole host: a failing or limiting server forbids everything, any other refusal allows everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How long what a host has answered holds.
TTL_HOURS = 6
RULES = "host string, groups int, agent string, position int, pattern string, allow boolean"


def product(agent: Column) -> Column:
    """The name of a crawler without its version."""
    return F.lower(F.trim(F.substring_index(agent, "/", 1)))


def rules(files: DataFrame) -> DataFrame:
    """host, agent, position, pattern, allow of files (host, status, body): a row for each rule and each agent of its group.

    A group begins with the first of consecutive agent lines. Empty patterns, comments and unknown lines are no rules, rules
    before any agent are left out. Answers 5xx and 429, or none, give one rule that forbids all; other refusals give none.
    """
    down = F.col("status").isNull() | (F.col("status") >= 500) | (F.col("status") == 429)
    lines = F.split(F.regexp_replace(F.coalesce("body", F.lit("")), "^\\uFEFF", ""), "\\r?\\n")
    pair = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"))
    bare = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: F.contains(x, F.lit(":")))
    read = files.where(F.col("status") < 400).select("host", F.posexplode(F.transform(bare, pair)).alias("position", "line")).select("host", "position", "line.*")
    is_agent = F.col("key") == "user-agent"
    in_file = W.partitionBy("host").orderBy("position")
    begins = is_agent & ~F.coalesce(F.lag(is_agent).over(in_file), F.lit(False))
    grouped = read.withColumn("begins", begins).withColumn("groups", F.sum(F.col("begins").cast("int")).over(in_file))
    agents = grouped.where(is_agent).select("host", "groups", F.lower("value").alias("agent")).distinct()
    found = grouped.where(F.col("key").isin("allow", "disallow") & (F.col("value") != "")).select("host", "groups", "position", F.col("value").alias("pattern"), (F.col("key") == "allow").alias("allow"))
    named = agents.join(found, ["host", "groups"], "left").select("host", "agent", "position", "pattern", "allow")
    shut = files.where(down).select("host", F.lit("*").alias("agent"), F.lit(0).alias("position"), F.lit("/").alias("pattern"), F.lit(False).alias("allow"))
    return named.unionByName(shut)


def matches(path: Column, pattern: Column) -> Column:
    """Whether a path begins with a pattern; ``*`` stands for anything, ``$`` at its end for the path's end."""
    bare = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.array_join(F.transform(F.split(bare, r"\*", -1), lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), ".*")
    return F.regexp_like(path, F.concat(F.lit("^(?s)"), quoted, F.when(pattern.endswith("$"), "$").otherwise("")))


def allowed(paths: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """host, path, allowed. The rules of groups whose agent is part of the crawler's name hold, else those of ``*``; the
    longest pattern decides, Allow wins ties, no pattern allows."""
    name = product(F.lit(agent))
    own = (F.col("agent") != "*") & F.contains(name, F.col("agent"))
    chosen = rules.where(own | (F.col("agent") == "*")).withColumn("own", own)
    chosen = chosen.withColumn("named", F.max("own").over(W.partitionBy("host"))).where("own = named and pattern is not null")
    asked = paths.select("host", "path").distinct()
    # rules of a host meet the paths of that host alone; a host of very many paths is split by adaptive execution
    hit = asked.join(chosen.select("host", "pattern", "allow").distinct(), "host").where(matches(F.col("path"), F.col("pattern")))
    best = hit.groupBy("host", "path").agg(F.max_by("allow", F.struct(F.length("pattern").alias("n"), "allow")).alias("allow"))
    return asked.join(best, ["host", "path"], "left").select("host", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))


def fresh(answers: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """The latest answer of each host (host, status, body, fetched_at) that still holds."""
    last = answers.groupBy("host").agg(F.max_by(F.struct("status", "body", "fetched_at"), "fetched_at").alias("a")).select("host", "a.*")
    return last.where(F.col("fetched_at") + F.make_dt_interval(F.lit(0), F.lit(ttl_hours)) >= now)
