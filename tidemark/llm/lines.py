"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two lines in a row has a local minimum about every third line; chunks end there. Where
they end depends on the lines nearby alone, so a passage that moves keeps its chunks. A run of one line, which has no minimum,
is a chunk of its own, and what is longer than ``MOST`` lines is cut from its beginning on, so runs of unequal lengths share
pieces too. A chunk of two or more lines that are
not blank and that stands in the corpus more than once stays where it comes first (by doc_id, then place) and is removed
everywhere else, once its bytes are known to be equal, not only its 128-bit hash.

Hashes of chunks are grouped without texts, and groups combine before they are shuffled. Bytes are compared by grouping on
them, for repeated chunks alone, so equal ones again combine first. Texts are shuffled to take in what was decided, never
to find it.

Null text stays null. Rows of one doc_id and one text are one document that stands in the table more than once: they are
treated alike. Rows of one doc_id with different texts come in the order of a hash of the text. A null doc_id comes first.
Extra columns stay as they are. An empty table gives no rows. Should two different chunks share a hash, both stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_row, row_columns, steps, text_or_empty, written

#: Of a document: its id, and a hash of its text.
KEY = "doc long, key long"


#: Lines of a chunk at most.
MOST = 32


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in lines), np.uint64, len(lines))


def chunk_bounds(lines: list[str]) -> list[tuple[int, int]]:
    """First and end line of each chunk."""
    if len(lines) < 4:
        return [(0, len(lines))]
    h = line_hashes(lines)
    rolled = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]  # of the lines i and i + 1
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.flatnonzero((rolled[1:-1] < rolled[:-2]) & (rolled[1:-1] < rolled[2:])) + 2
    # equal neighbours among the rolled values are three equal lines or more: they begin and end chunks
    same = np.diff((rolled[1:] == rolled[:-1]).astype(np.int8), prepend=0, append=0)
    ends = np.unique(np.concatenate(([0], low, np.flatnonzero(same == 1), np.flatnonzero(same == -1) + 2, [len(lines)]))).tolist()
    return [(at, min(at + MOST, b)) for a, b in zip(ends, ends[1:], strict=False) for at in range(a, b, MOST)]


def multi_line(lines: list[str]) -> bool:
    return sum(1 for x in lines if x.strip()) > 1


def _keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text_or_empty()).alias("key")]


def chunks(docs: DataFrame) -> DataFrame:
    """doc, key (key of a document), at (which chunk of it), h, g (128-bit hash) of each chunk of several lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            rows = []
            for doc, key, text in zip(step["doc"], step["key"], step["text"], strict=True):
                lines = (text or "").split("\n")
                for at, (a, b) in enumerate(chunk_bounds(lines)):
                    if b - a > 1 and multi_line(lines[a:b]):
                        d = np.frombuffer(xxhash.xxh3_128_digest("\n".join(lines[a:b])), "<i8")
                        rows.append((doc, key, at, int(d[0]), int(d[1])))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc", "key", "at", "h", "g"])

    return docs.select(*_keys(), "text").mapInArrow(run, f"{KEY}, at int, h long, g long")


def _bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, g, bytes of the chunks at the places ``wanted`` (doc, key, ats: array of at)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            rows = []
            for text, ats in zip(step["text"], step["ats"], strict=True):
                lines = (text or "").split("\n")
                bounds = chunk_bounds(lines)
                for at in ats:
                    chunk = "\n".join(lines[slice(*bounds[at])])
                    d = np.frombuffer(xxhash.xxh3_128_digest(chunk), "<i8")
                    rows.append((int(d[0]), int(d[1]), chunk))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string()], strict=True)], ["h", "g", "bytes"])

    texts = docs.select(*_keys(), "text").join(wanted.hint("shuffle_hash"), ["doc", "key"])
    return texts.select("text", "ats").mapInArrow(run, "h long, g long, bytes string")


def _without(text: pd.Series, ats: pd.Series) -> pd.DataFrame:
    rows = []
    for t, gone in zip(text, ats, strict=True):
        if t is None or gone is None:
            rows.append((None, 0, 0))
            continue
        lines, drop = t.split("\n"), set(gone)
        bounds = chunk_bounds(lines)
        kept = [x for at, (a, b) in enumerate(bounds) if at not in drop for x in lines[a:b]]
        rows.append(("\n".join(kept), len(drop), len(lines) - len(kept)))
    return pd.DataFrame(rows, columns=["text", "removed_chunks", "removed_lines"])


def deduplicated(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` without the lines of repeated chunks; n_chars, where it exists, follows the text.

    With ``counts`` two more columns: removed_chunks and removed_lines.
    """
    every = written(chunks(docs), "chunks")
    place = F.struct("doc", "key", "at")
    repeated = every.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first")
    repeated = written(repeated, "chunk_groups")  # a plain table on this side lets adaptive execution split a hot chunk's rows
    found = written(every.join(repeated, ["h", "g"]), "repeated")
    wanted = found.groupBy("doc", "key").agg(F.collect_set("at").alias("ats"))
    differ = written(_bytes(docs, wanted).groupBy("h", "g", "bytes").agg(F.count("*")).groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"), "collisions")
    gone = found.where(place != F.col("first")).join(differ, ["h", "g"], "left_anti").groupBy("doc", "key").agg(F.collect_set("at").alias("gone"))
    rows = docs.select(*_keys(), as_row(docs)).join(gone.hint("shuffle_hash"), ["doc", "key"], "left")
    hit, text = F.col("gone").isNotNull(), F.col("row.text")
    rows = rows.withColumn("new", F.pandas_udf(_without, "text string, removed_chunks int, removed_lines int")(F.when(hit, text), F.col("gone")))
    new = {"text": F.when(hit, F.col("new.text")).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("new.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    more = [F.coalesce(f"new.{c}", F.lit(0)).alias(c) for c in ("removed_chunks", "removed_lines")] if counts else []
    return rows.select(*row_columns(docs, **new), *more)
