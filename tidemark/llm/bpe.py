"""Byte-level BPE encoding and decoding as a monoid: halves are encoded recursively, neighbours are joined at their border.

An element is a text with its ids. The join of two neighbours re-encodes a window around the border and keeps the ids
outside it. The window grows until it ends, on either side, where a space follows a character that is not white space (or
at an end of the text). There the ids outside are provably those of the joined text: in the pattern a space stands only
first in a match or in a match of white space alone, so each match ends before such a space, whatever lies further on; a
match depends on nothing before its start; and merges stay inside a match.

Decoding maps ids to bytes in leaves and concatenates up the tree, so a character cut between leaves comes out whole.

Null text counts as empty: no ids, no bytes. Repeated rows are encoded each. Extra columns are ignored. An empty table
gives no rows. There is no shuffle; a task that runs again gives the same rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import steps

#: Characters of a leaf, and of the first window on either side of a border.
LEAF, WINDOW = 4096, 64
#: Where a text can be cut for certain: before a space that follows a character that is not white space.
_CUT = re.compile(r"(?<=\S)(?= )")


def _last_cut(text: str, window: int) -> int:
    """The last certain cut of a left neighbour, looked for in ever larger windows at its end; 0 if there is none."""
    while True:
        begin = max(0, len(text) - window)
        at = text.rfind(" ", begin + 1)
        while at > begin:
            if not text[at - 1].isspace():
                return at
            at = text.rfind(" ", begin + 1, at)
        if not begin:
            return 0
        window *= 2


def _first_cut(text: str, window: int) -> int:
    """The first certain cut of a right neighbour; its length if there is none."""
    while True:
        # a look-behind sees the character before, so windows need no overlap
        if m := _CUT.search(text, 0, window + 1):
            if m.start() < len(text):
                return m.start()
        if window >= len(text):
            return len(text)
        window *= 2


def _ids_after(ids: np.ndarray, n_bytes: int, lengths: np.ndarray) -> int:
    """How many ids at the end make up ``n_bytes`` bytes."""
    n = 16
    while True:
        ends = np.cumsum(lengths[ids[::-1][:n]])
        at = int(np.searchsorted(ends, n_bytes))
        if at < len(ends) or n >= len(ids):
            return at + 1 if n_bytes else 0
        n *= 2


def _ids_before(ids: np.ndarray, n_bytes: int, lengths: np.ndarray) -> int:
    n = 16
    while True:
        ends = np.cumsum(lengths[ids[:n]])
        at = int(np.searchsorted(ends, n_bytes))
        if at < len(ends) or n >= len(ids):
            return at + 1 if n_bytes else 0
        n *= 2


def join(left: tuple[str, list[np.ndarray]], right: tuple[str, list[np.ndarray]], path: str, window: int = WINDOW) -> tuple[str, list[np.ndarray]]:
    """The element of the joined text. An element's ids are a list of arrays, so a join copies only its border."""
    (a, x), (b, y) = left, right
    if not a or not b:
        return (a + b, x + y)
    lengths = tokens.bytes_of_id(path)[0]
    i, j = _last_cut(a, window), _first_cut(b, window)
    drop_a, drop_b = len(a[i:].encode()), len(b[:j].encode())
    x, y = list(x), list(y)
    while drop_a:
        ids = x.pop()
        if (n := int(lengths[ids].sum())) <= drop_a:
            drop_a -= n
            continue
        x.append(ids[: len(ids) - _ids_after(ids, drop_a, lengths)])
        drop_a = 0
    while drop_b:
        ids = y.pop(0)
        if (n := int(lengths[ids].sum())) <= drop_b:
            drop_b -= n
            continue
        y.insert(0, ids[_ids_before(ids, drop_b, lengths) :])
        drop_b = 0
    return (a + b, [*x, tokens.ids(a[i:] + b[:j], path), *y])


def encode(text: str, path: str = tokens.RANKS, leaf: int = LEAF, window: int = WINDOW) -> np.ndarray:
    """Ids of a text by tree reduction over leaves of at most ``leaf`` characters."""

    def tree(begin: int, end: int) -> tuple[str, list[np.ndarray]]:
        if end - begin <= leaf:
            part = text[begin:end]
            return part, [tokens.ids(part, path)]
        half = (begin + end) // 2
        return join(tree(begin, half), tree(half, end), path, window)

    got = tree(0, len(text))[1]
    return np.concatenate(got) if len(got) > 1 else got[0]


def decode(ids: np.ndarray, path: str = tokens.RANKS, leaf: int = LEAF) -> bytes:
    """Bytes of ids by tree reduction."""
    if len(ids) <= leaf:
        return tokens.encoding(path).decode_bytes(ids.tolist())
    half = len(ids) // 2
    return decode(ids[:half], path, leaf) + decode(ids[half:], path, leaf)


def encoded(docs: DataFrame, path: str = tokens.RANKS, leaf: int = LEAF, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the bytes
    that the ids decode to) and, if ``with_ids``, ids of every row of ``docs``."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            rows = []
            for text in step["text"]:
                got = encode(text or "", path, leaf)
                rows.append((len(got), hashlib.sha256(got.tobytes()).hexdigest(), hashlib.sha256(decode(got, path, leaf)).hexdigest(), got.astype(np.int32)))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(step["doc_id"], pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(cols[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decoded(encoded_docs: DataFrame, path: str = tokens.RANKS, leaf: int = LEAF) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [decode(np.asarray(x or [], np.uint32), path, leaf).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.string())], ["doc_id", "text"])

    return encoded_docs.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
