"""Document fingerprints: threshold-scaled sketches, in DataFrame functions alone.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the hash range, and the least hash of all, so
that short texts have one too. Sketches of parts merge into the sketch of the whole (``merged``), and the share of one
sketch found in another estimates containment whatever the two sizes.

Words are runs of characters other than white space; a text of fewer than five words is one shingle, a text of none has
an empty sketch. Null text counts as empty. Two empty sketches are alike (1), an empty one and another are not (0).
Rows that repeat, also in their doc_id, each get their sketch, and follow each other in the order of their texts; a null
doc_id comes first. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

WORDS = 5
#: One of so many shingle hashes is kept.
SCALE = 2
#: Rows that the neighbours' buckets aim at; it sets how finely the table is dealt, not what is computed.
BUCKET_ROWS = 4000
#: Buckets at most: their bounds, a long each, go through the driver.
MOST_BUCKETS = 20_000


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted array<long> of the hashes that a text's sketch keeps."""
    bound = F.lit(-(1 << 63) + (1 << 64) // scale)
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    hashes = F.transform(parts, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        # `h` is bound once by the one-row transform around this, so it is not computed again for each shingle
        rolled = F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(words)]))
        return F.when(F.size(h) >= words, rolled).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    every = F.transform(F.array(hashes), shingles)

    def kept(s: Column) -> Column:
        return F.array_union(F.filter(s, lambda x: x < bound), F.when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(F.array().cast("array<long>")))

    return F.sort_array(F.element_at(F.transform(every, kept), 1))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of what two sketches stand for together."""
    bound = F.lit(-(1 << 63) + (1 << 64) // scale)
    both = F.array_union(a, b)
    return F.sort_array(F.filter(both, lambda x: (x < bound) | (x == F.array_min(both))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first's shingles that the second has, 0 to 1."""
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def as_string(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the row that follows by doc_id (after the last: the first).

    Rows are dealt into ranges of doc_id whose bounds are doc_ids of the table; the first row of each range is dealt to the
    range before it as well, so every row finds its successor in its own range and no sort sees the whole table. Rows of
    one doc_id follow each other in the order of their first column; null doc_ids come first.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select("doc_id", *columns)
    rows = docs.select(key.alias("_key"), "*")
    n = min(MOST_BUCKETS, max(1, rows.count() // BUCKET_ROWS))
    first, bounds = rows.agg(F.min("_key"), F.percentile_approx("_key", [i / n for i in range(1, n)] or [0.0], 10 * n)).first()
    if first is None:
        bounds = []
    cuts = sorted({b for b in bounds if b > first})
    edges = F.lit(cuts) if cuts else F.array().cast("array<long>")
    # how many cuts are not above the key, by halving steps over the sorted literal
    halvings = F.lit([1 << i for i in reversed(range(max(1, len(cuts).bit_length())))])

    def halve(at: Column, by: Column) -> Column:
        return F.when((at + by <= len(cuts)) & (F.get(edges, at + by - 1) <= F.col("_key")), at + by).otherwise(at)

    own = F.aggregate(halvings, F.lit(0), halve) if cuts else F.lit(0)
    rows = rows.withColumn("_own", own)
    own = F.col("_own")
    begins = (own > 0) & (F.get(edges, own - 1) == F.col("_key"))
    places = F.array_compact(F.array(F.struct(own.alias("bucket"), F.lit(0).alias("halo")), F.when(begins, F.struct((own - 1).alias("bucket"), F.lit(1).alias("halo"))), F.when(F.col("_key") == F.lit(first), F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(2).alias("halo")))))
    dealt = rows.select(F.explode(places).alias("_p"), "_key", *docs.columns).select("_p.bucket", "_p.halo", "_key", *docs.columns)
    spec = f"OVER (PARTITION BY bucket ORDER BY halo = 2, _key, {columns[0]})"
    nexts = [F.expr(f"LEAD({c}) {spec}").alias(f"next_{c}") for c in columns]
    return dealt.select("bucket", "halo", *docs.columns, *nexts).where("halo = 0").drop("bucket", "halo")


def fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Per row: doc_id, text, sketch; edited (the text whose last quarter of code points the beginning of the next
    document's text replaces), edited_sketch, next_sketch."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    own = own.withColumn("sketch", sketch(F.col("text"), words, scale))
    both = with_next(own, ["text", "sketch"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter))
    both = both.withColumn("edited", edited)
    return both.select("doc_id", "text", "sketch", "edited", sketch(F.col("edited"), words, scale).alias("edited_sketch"), F.col("next_sketch"))
