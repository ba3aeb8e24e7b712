"""Packing of token ids into training sequences.

Two packers share one shape: a document's ids (its text's ids and a closing id) are cut into full windows of ``capacity``
ids and a rest; the rests that one task has read are packed in buffers of bounded size. Nothing is shuffled: a task's
buffer sees consecutive rows, whatever their source, so a hot source or a group of copies makes no task larger. The
sequence ids of partition ``p`` start at ``p << 33``; a task that runs again for a lost executor gives the same ids.

* ``pack_balanced``: multiway differencing (Karmarkar-Karp) gives windows of nearly equal fill; one window more whenever
  the largest exceeds the capacity.
* ``pack_best_fit``: best-fit decreasing; a segment tree over remaining capacities finds the fullest window that still fits.

Ids are those of the vocabulary's JSON file, where the text of an added token is that token (``tokens.library_ids``).

Null text counts as empty: such a document is its closing id alone. Repeated rows are packed as often as they occur.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import steps

CAPACITY = 2048
CLOSING_ID = 1
#: Rests that one buffer holds: they bound the memory of a task and the loss at its end, half a window on average.
BUFFER = 1024
#: Longest piece of a rest that balanced packing moves as one; at the capacity no rest is cut. Differencing balances several
#: pieces a window far better than two or three: a quarter of the capacity leaves 0.8 % of padding, no cuts 1.7 %.
PIECE = CAPACITY // 4


class Tree:
    """Segment tree over the capacities 0..n: which of them some open window has left."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that occurs."""
        i = need + self.size
        if self.count[i]:
            return need
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # the right sibling holds larger capacities only
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of indices into ``lengths`` (each at most ``capacity``)."""
    tree, left, windows = Tree(capacity), [[] for _ in range(capacity + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room is None:
            windows.append([])
            w, room = len(windows) - 1, capacity
        else:
            w = left[room].pop()
            tree.add(room, -1)
        windows[w].append(i)
        room -= lengths[i]
        left[room].append(w)
        tree.add(room, 1)
    return windows


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """``k`` near-equal windows: the two partial partitions of largest imbalance merge, large sides onto small sides."""
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    nodes: list[tuple[int, int]] = [(-1, -1)] * len(lengths)  # of the trees that hold which pieces stand together; -1: none
    for i, n in enumerate(lengths):
        sums, held = np.zeros(k, np.int64), np.full(k, -1)
        sums[-1], held[-1] = n, i
        heap.append((-n, i, sums, held))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, at, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        held = np.where(x < 0, y, x)
        for j in np.flatnonzero((x >= 0) & (y >= 0)):
            nodes.append((int(x[j]), int(y[j])))
            held[j] = len(nodes) - 1
        order = np.argsort(sums, kind="stable")
        sums, held = sums[order], held[order]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), at, sums, held))
    windows = []
    for root in heap[0][3] if heap else []:
        window, stack = [], [int(root)]
        while stack:
            i = stack.pop()
            if i < 0:
                continue
            if i < len(lengths):
                window.append(i)
            else:
                stack += nodes[i]
        windows.append(sorted(window))
    return [w for w in windows if w]


def balanced(lengths: list[int], capacity: int) -> list[list[int]]:
    """The fewest near-equal windows that differencing fits into ``capacity``."""
    if not lengths:
        return []
    k = -(-sum(lengths) // capacity)
    while True:
        windows = differencing(lengths, k)
        if max(sum(lengths[i] for i in w) for w in windows) <= capacity:
            return windows
        k += 1


def _pieces(row: int, n: int, capacity: int, piece: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Full windows and pieces of the rest of a document of ``n`` ids, as (row, start, length)."""
    full = n // capacity
    whole = [(row, i * capacity, capacity) for i in range(full)]
    begin, parts = full * capacity, -(-(n - full * capacity) // piece)
    cuts = [begin + (n - begin) * i // max(parts, 1) for i in range(parts + 1)]
    return whole, [(row, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _sequences(batches: Iterable[pa.RecordBatch], pack: Callable[[list[int]], list[list[int]]], capacity: int, piece: int, path: str, vocab: str, closing: int) -> Iterator[tuple[int, list[tuple[int, int, int, np.ndarray, int]]]]:
    """(sequence id, its pieces as (doc_id, start, length, ids, ids of the document)) over all rows of a partition."""
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    held: list[tuple[int, int, int, np.ndarray, int]] = []
    for step in steps(batches):
        for doc, text in zip(step["doc_id"], step["text"], strict=True):
            got = np.append(tokens.library_ids(text or "", path, vocab), np.array([closing], "<u4")).astype("<u4")
            whole, rest = _pieces(0, len(got), capacity, piece)
            for _, a, n in whole:
                yield number, [(doc, a, n, got[a : a + n], len(got))]
                number += 1
            held += [(doc, a, n, got[a : a + n].copy(), len(got)) for _, a, n in rest]
            while len(held) >= BUFFER:
                now, held = held[:BUFFER], held[BUFFER:]
                for window in pack([x[2] for x in now]):
                    yield number, [now[i] for i in window]
                    number += 1
    for window in pack([x[2] for x in held]):
        yield number, [held[i] for i in window]
        number += 1


def pack_balanced(docs: DataFrame, capacity: int = CAPACITY, piece: int = PIECE, path: str = tokens.RANKS, vocab: str = tokens.VOCAB_JSON, closing: int = CLOSING_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, each id in one piece, in near-equal windows of at most ``capacity`` ids.

    Returns doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), doc_tokens,
    sequence_id, offset (gapless from 0 in a sequence) and, if ``with_ids``, ids.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in list(zip(*[r[:7] for r in rows], strict=True))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array([r[7].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        for number, window in _sequences(batches, lambda n: balanced(n, capacity), capacity, piece, path, vocab, closing):
            offset = 0
            for doc, start, n, got, all_ids in window:
                rows.append((doc, start, n, zlib.crc32(got.tobytes()), all_ids, number, offset, got if with_ids else None))
                offset += n
            if len(rows) >= 2000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack_best_fit(docs: DataFrame, capacity: int = CAPACITY, path: str = tokens.RANKS, vocab: str = tokens.VOCAB_JSON, closing: int = CLOSING_ID, padding: int = 0) -> DataFrame:
    """One row for each packed sequence, in the layout that a training job reads.

    sequence_id, n_tokens, doc_ids and starts (of its segments, in order), cu_seqlens (cumulative segment lengths from 0),
    input_ids (one row of the id matrix: ``capacity`` little-endian unsigned 16-bit ids, 32-bit where the vocabulary needs
    them, padded with ``padding``), position_ids (the same layout; it counts from 0 anew at each segment, padding is 0).
    A document of more than ``capacity`` ids is split into full windows and a rest: joined by doc_id and start its segments
    give all its ids.
    """
    wide = "<u2" if tokens.encoding(path, vocab).n_vocab <= 1 << 16 else "<u4"
    schema = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for number, window in _sequences(batches, lambda n: best_fit_decreasing(n, capacity), capacity, capacity, path, vocab, closing):
            ends = np.cumsum([0] + [x[2] for x in window])
            matrix, places = np.full(capacity, padding, wide), np.zeros(capacity, wide)
            for (_, _, n, got, _), a in zip(window, ends, strict=False):
                matrix[a : a + n] = got
                places[a : a + n] = np.arange(n)
            rows.append((number, int(ends[-1]), [x[0] for x in window], [x[1] for x in window], ends.tolist(), matrix.tobytes(), places.tobytes()))
            if len(rows) >= 500:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """The packed sequences as Parquet files: each row group's input_ids are one matrix, row by row."""
    pack_best_fit(docs, **options).write.mode("overwrite").parquet(path)
