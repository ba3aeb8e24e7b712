"""Secret scans with an incremental blob ledger, in DataFrame functions alone.

Every text is a blob named by its SHA-256, and every rule has a version. The ledger says which blob was scanned by which
rule versions; a scan takes only pairs of a blob and a rule version that it does not have, each blob once however many rows
hold it: a new text is scanned by all rules, a known one by the rules that are new or changed. Findings are joined back to
all rows. Blobs are found from (row, blob) pairs without texts; of the texts that pass a cheap test where they are read, one
copy of each blob with something to scan is shuffled once.

Positions come from the two halves of one regular expression pass: what lies between the matches and the matches
themselves, whose lengths add up to starts and ends in code points.

Null text counts as empty: no findings. Rows that repeat, also in their doc_id, each get their text's findings. Extra
columns are ignored (``redacted`` keeps them, whatever their names). An empty table gives no rows. A blob that a third of all
rows hold is one row until the last join, which adaptive execution can split. Scans of one ledger that overlap in time may
record a pair twice: that is made good on reading.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from .common import as_row, row_columns, text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """``quick`` is a cheap pattern, ``mark`` a string, that each text with a match holds. Raise ``version`` with every change
    of a pattern: texts scanned before are then scanned by that rule again."""

    kind: str
    pattern: str
    group: int
    least: int
    quick: str | None = None
    mark: str | None = None
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: From the BEGIN line of a key to its END line or the next BEGIN; a key that neither follows ends where its base64 does.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|(?=-----BEGIN ))|\s*[A-Za-z0-9+/=]{16}[A-Za-z0-9+/=\s]*)?"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The first three are the base kinds. Access keys and hexadecimal runs have the least length in the pattern: their matches
#: cannot begin later in the same run.
RULES = (
    Rule("assign", ASSIGN, 2, 6, quick=r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, mark="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, quick=r"[0-9a-f]{24}"),
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, mark="gh"),
    Rule("pem", PEM, 0, 27, mark="-----BEGIN ", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, mark="eyJ"),
)
#: The rules as they were before: keys by their first line alone, no web tokens.
EARLIER_RULES = (*RULES[:4], Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27, mark="-----BEGIN "))
BASE = tuple(rule.kind for rule in RULES[:3])
RANK = {rule.kind: i for i, rule in enumerate(RULES)}
SPAN = "struct<start:int,rank:int,end:int,kind:string,version:int>"
LEDGER = f"blob_id binary, rules array<string>, spans array<{SPAN}>"
REDACTED = "[SECRET]"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _likely(text: Column, rule: Rule) -> Column:
    """The rule's cheap test, which every text with a match passes."""
    return text.rlike(rule.quick) if rule.quick else F.contains(text, F.lit(rule.mark))


def _spans(text: Column, rule: Rule) -> Column:
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("m")
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("g")
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches, counted)
    start = F.struct(F.lit(0).alias("at"), _none().alias("found"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["m"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(RANK[rule.kind]).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))
        return F.struct(end.alias("at"), F.when(F.length(part["g"]) >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    return F.when(_likely(text, rule), F.aggregate(parts, start, step, lambda state: state["found"])).otherwise(_none())


def as_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _names(rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(r.name) for r in rules])


def paths(docs: DataFrame) -> DataFrame:
    """doc_id, blob_id of every row of ``docs``, written once: what a scan and its report need of rows besides their texts."""
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_id(text_or_empty()).alias("blob_id")), "paths")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, where: DataFrame | None = None) -> DataFrame:
    """blob_id, rules (names with versions), spans: a row for each blob of ``docs`` with rules that ``ledger`` (the same
    columns) lacks, and what these rules find in it. ``where``: ``paths(docs)``, if they are known."""
    unseen = (paths(docs) if where is None else where).groupBy("blob_id").agg(F.min("doc_id").alias("doc_id"))
    todo = _names(rules)
    if ledger is not None:
        seen = ledger.select("blob_id", F.explode("rules").alias("rule")).groupBy("blob_id").agg(F.collect_set("rule").alias("seen"))  # as many as there are rules
        todo = F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))
        unseen = unseen.join(seen, "blob_id", "left")
    unseen = written(unseen.select("blob_id", "doc_id", todo.alias("todo")).where(F.size("todo") > 0), "unseen")
    # rules that some blob still lacks, no more than there are rules: texts are tested for these alone
    lacked = {r.rule for r in unseen.select(F.explode("todo").alias("rule")).distinct().collect()}
    due = tuple(r for r in rules if r.name in lacked)
    if not due:
        return unseen.select("blob_id", F.col("todo").alias("rules"), _none().alias("spans"))
    # texts that pass no such test where they are read have no new findings: only the others are shuffled, one of each blob
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    likely = rows.where(reduce(lambda x, y: x | y, [_likely(F.col("text"), r) for r in due])).withColumn("blob_id", blob_id(F.col("text")))
    texts = likely.alias("r").join(unseen.hint("shuffle_hash").alias("u"), F.expr("r.doc_id <=> u.doc_id AND r.blob_id = u.blob_id")).select("r.blob_id", "r.text", "todo")
    found = F.array_sort(F.concat(*[F.when(F.array_contains("todo", r.name), _spans(F.col("text"), r)).otherwise(_none()) for r in due]))
    spans = texts.select("blob_id", found.alias("spans")).where(F.size("spans") > 0).dropDuplicates(["blob_id"])
    return unseen.join(spans, "blob_id", "left").select("blob_id", F.col("todo").alias("rules"), F.coalesce("spans", _none()).alias("spans"))


def current(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob_id, spans of all blobs of a ledger under ``rules``, by start, then rank; what was recorded twice counts once."""
    known = F.filter("spans", lambda s: F.array_contains(_names(rules), F.concat_ws("@", s["kind"], s["version"].cast("string"))))
    return ledger.select("blob_id", known.alias("spans")).groupBy("blob_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def joined_back(where: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, blob_id, spans of every row of ``where``, the paths of documents; ``found`` has a row for each blob."""
    return where.join(found.select("blob_id", "spans"), "blob_id", "left").select("doc_id", "blob_id", F.coalesce("spans", _none()).alias("spans"))


class BlobLedger:
    """What was found in all blobs scanned so far, as Parquet below ``path``; each scan appends what is new."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def seen(self) -> DataFrame | None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, where: DataFrame | None = None) -> DataFrame:
        """doc_id, blob_id, spans of every row; pairs of blobs and rules that are new to the ledger are scanned and recorded.
        ``where``: ``paths(docs)``, if several scans use them."""
        where = paths(docs) if where is None else where
        scan(docs, self.seen(), rules, where).write.mode("append").parquet(self.path)
        return joined_back(where, current(self.seen(), rules))


def new_ledger(spark: SparkSession) -> BlobLedger:
    """A ledger in the session's shared folder, for one query."""
    return BlobLedger(spark, f"{scratch(spark, 'ledger')}/table")


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, blob_id, spans of every row, from an empty ledger."""
    return new_ledger(docs.sparkSession).scan(docs)


def redacted(docs: DataFrame, mark: str = REDACTED) -> DataFrame:
    """``docs`` with every span of every kind (overlapping ones as one) of its texts replaced by ``mark``; n_chars follows the text."""
    ledger = new_ledger(docs.sparkSession)
    ledger.scan(docs)
    found = current(ledger.seen()).where(F.size("spans") > 0)
    rows = docs.select(blob_id(text_or_empty()).alias("blob_id"), as_row(docs)).join(found, "blob_id", "left")
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        here = F.concat(state["out"], text.substr(state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0))), F.when(s["start"] >= state["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), here.alias("out"))

    clean = F.aggregate("spans", start, step, lambda state: F.concat(state["out"], text.substr(state["at"] + 1, F.length(text))))
    hit = F.col("spans").isNotNull()
    rows = rows.select(F.when(hit, clean).otherwise(text).alias("clean"), hit.alias("hit"), "row")
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*row_columns(docs, **new))
