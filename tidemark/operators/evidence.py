"""Which documents hold which passages, as an equi-join.

A passage inside a text has all its words but the first and the last as whole words of the text, in a row. Up to ``LEAD`` of
these inner words, from the second on, are a passage's key; a text has the keys of all its runs of words of that length. Keys
alone meet, then the texts that were met are searched for the passage itself. Passages of one or two words have no inner word:
their key is the three characters they begin with, or the whole passage if it is shorter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import for_match, once

LEAD = 6
#: Characters of the key of a passage without inner words.
SHORT = 3


def _runs(words: Column, length: int) -> Column:
    """A hash of every ``length`` words in a row."""
    return once(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (length - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(length)])))


def _pieces(text: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - (length - 1)), lambda i: F.xxhash64(F.substring(text, i, F.lit(length))))


def containing(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id of documents (doc_id, text) that hold passages (item_id, text), both as ``for_match`` gives them. Blank
    passages are in no document."""
    asked = passages.select("item_id", for_match(F.col("text")).alias("passage")).where("passage <> ''")
    words = F.split("passage", " ")
    inner = F.least(F.size(words) - 2, F.lit(LEAD))
    # the kind of a key: how many inner words it has, or less how many characters
    kind = F.when(inner > 0, inner).otherwise(-F.least(F.length("passage"), F.lit(SHORT)))
    asked = asked.select("item_id", "passage", kind.alias("kind"), words.alias("words"))
    kinds = [r["kind"] for r in asked.select("kind").distinct().collect()]  # LEAD + SHORT at most
    texts = documents.select("doc_id", for_match(F.col("text")).alias("document"))
    split = texts.select("doc_id", "document", F.split("document", " ").alias("words"))
    met = None
    for k in kinds:
        key = F.xxhash64(*[F.xxhash64(F.get("words", F.lit(i + 1))) for i in range(k)]) if k > 0 else F.xxhash64(F.substring("passage", 1, -k))
        ask = asked.where(F.col("kind") == k).select(key.alias("key"), "item_id")
        enough = F.size("words") >= k if k > 0 else F.length("document") >= -k
        has = split.where(enough).select("doc_id", F.explode(F.array_distinct(_runs(F.col("words"), k) if k > 0 else _pieces(F.col("document"), -k))).alias("key"))
        one = has.join(ask, "key").select("doc_id", "item_id")
        met = one if met is None else met.unionByName(one)
    if met is None:
        return documents.select("doc_id").join(passages.select("item_id"), F.lit(False))
    return met.distinct().join(texts, "doc_id").join(asked.select("item_id", "passage"), "item_id").where(F.contains("document", "passage")).select("doc_id", "item_id").distinct()
