"""Centroid clustering in exact integers, with one upper and one lower bound a vector (Hamerly's bounds).

Every vector carries its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to any
other. When centroids move, the upper bound grows by its own centroid's move, the lower one shrinks by the largest move of
the others. As long as the upper bound is below the lower one, or below half the way from its centroid to the nearest other,
the nearest centroid is known without a distance. Otherwise the distance to the own centroid is taken anew; only if that does
not settle it are all distances computed. Bounds are integers, upper ones rounded up and lower ones down, and have to differ
to decide: a tie always goes to the full scan, where the smaller number wins.

On Spark: vectors and bounds are one table, which a round reads and writes anew (``mapInArrow``), so nothing but tallies is
ever shuffled. Each task adds a row of size and sums for each cluster; they stand at the end of its file and have columns of
their own, so reading them skips the vectors. Only the sums of all tasks, k times the number of components, come to the
driver. A table is deleted when the one after next needs no more of it; a lost executor costs the files it was writing.

Vectors that are null, have another number of components, a null or non-finite one, or one too large for exact sums
(``vectors.MOST_BITS``) are left out. Repeated rows count as often as they occur; a null id is kept, but is the last to be a
first centroid. With fewer vectors than clusters each is a centroid at first. Extra columns are ignored. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .vectors import inner, matrix, scaled, usable

#: More than any distance, and no less than any squared one.
FAR, FAR_SQUARED = 2**40, 2**62
_ROW = "id long, v array<int>, cluster int, upper long, lower long, distance long, scanned boolean, tally boolean, size long, sums array<long>, inertia long"


def prepared(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """id, v of the vectors that take part."""
    kept = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x")).where((F.size("x") == dims) & usable("x", scale))
    return kept.select("id", scaled("x", scale).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the ``k`` smallest hashes of salt and id; of equal ids the smaller vector comes first."""
    by_hash = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    return [r.v for r in rows.orderBy(by_hash.asc_nulls_last(), "v").limit(k).select("v").collect()]


def root_down(x: np.ndarray) -> np.ndarray:
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def root_up(x: np.ndarray) -> np.ndarray:
    r = root_down(x)
    return r + (r * r < x)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``v`` to all rows of ``c``."""
    return (v * v).sum(1)[:, None] - 2 * inner(v, c) + (c * c).sum(1)[None, :]


class Step:
    """One round's centroids, and what their moves since the last round (null before the first) mean for bounds."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        self.c = np.array(centroids, np.int64)
        k = len(self.c)
        self.moved = np.zeros(k, np.int64) if before is None else root_up(((self.c - np.array(before, np.int64)) ** 2).sum(1))
        others = np.where(np.eye(k, dtype=bool), -1, self.moved[None, :])
        self.others_moved = np.maximum(others.max(1), 0)
        gaps = np.where(np.eye(k, dtype=bool), FAR_SQUARED, squared(self.c, self.c))
        self.apart = root_down(gaps.min(1)) if k > 1 else np.array([2 * FAR + 1])

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """cluster, upper, lower, and which vectors took a full scan."""
        cluster, upper, lower = cluster.copy(), upper + self.moved[cluster], lower - self.others_moved[cluster]
        open_ = np.flatnonzero((upper >= lower) & (2 * upper >= self.apart[cluster]))
        own = cluster[open_]
        upper[open_] = root_up(((v[open_] - self.c[own]) ** 2).sum(1))
        full = open_[(upper[open_] >= lower[open_]) & (2 * upper[open_] >= self.apart[own])]
        scanned = np.zeros(len(v), bool)
        scanned[full] = True
        if len(full):
            d = squared(v[full], self.c)
            cluster[full] = d.argmin(1)
            near = np.partition(d, 1, axis=1)[:, :2] if d.shape[1] > 1 else np.column_stack([d[:, 0], np.full(len(d), FAR_SQUARED)])
            upper[full], lower[full] = root_up(near[:, 0]), root_down(near[:, 1])
        return cluster, upper, lower, scanned


def _round(table: DataFrame, step: Step, measure: bool) -> DataFrame:
    """``table`` (id, v, cluster, upper, lower) with clusters and bounds after a round, and its tasks' tallies. ``measure``: with distances."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = step.c.shape
        sizes, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), *((n, pa.int64()) for n in ("upper", "lower", "distance")), ("scanned", pa.bool_()), ("tally", pa.bool_()), ("size", pa.int64()), ("sums", pa.list_(pa.int64())), ("inertia", pa.int64())])
        for batch in batches:
            v = matrix(batch.column("v"), dims)
            cluster, upper, lower, scanned = step.assign(v, *(batch.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "upper", "lower")))
            sizes += np.bincount(cluster, minlength=k)
            for j in range(k):
                sums[j] += v[cluster == j].sum(0)
            distance = ((v - step.c[cluster]) ** 2).sum(1) if measure else None
            if measure:
                np.add.at(inertia, cluster, distance)
            n = len(v)
            gone = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v").cast(pa.list_(pa.int32())), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance) if measure else gone, pa.array(scanned), pa.array(np.zeros(n, bool)), gone, pa.nulls(n, pa.list_(pa.int64())), gone], schema=schema)
        gone = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays([gone, pa.nulls(k, pa.list_(pa.int32())), pa.array(np.arange(k), pa.int32()), gone, gone, gone, pa.nulls(k, pa.bool_()), pa.array(np.ones(k, bool)), pa.array(sizes), pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(inertia)], schema=schema)

    return written(table.select("id", "v", "cluster", "upper", "lower").mapInArrow(run, _ROW), "clusters")


def _moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Means, rounded down, of the clusters that have vectors; k rows of sums come to the driver."""
    parts = table.where("tally").select("cluster", "size", F.posexplode("sums").alias("pos", "part"))
    sums = parts.groupBy("cluster", "pos").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"), F.sum("size").alias("n")).where("n > 0")
    out = [list(c) for c in centroids]
    for r in sums.collect():
        out[r.cluster][r.pos] = int(r.s) // r.n
    return out


def clustered(rows: DataFrame, k: int = 8, rounds: int = 10, salt: str = "3:") -> tuple[DataFrame, list[list[int]], list[int]]:
    """A table (id, v, cluster, distance, ...) of ``rows`` (id, v) after ``rounds`` rounds and a last assignment, the
    centroids, and each cluster's sum of squared distances. A round that moves no centroid is the last that can change
    anything, so the rest is left out."""
    centroids, before = first_centroids(rows, k, salt), None
    table = rows.select("id", "v", F.lit(0).alias("cluster"), F.lit(FAR).cast("long").alias("upper"), F.lit(-1).cast("long").alias("lower"))
    if not centroids:
        return table.withColumn("distance", F.lit(None).cast("long")), [], []
    last = None
    for n in range(rounds + 1):
        done = n == rounds or before == centroids
        new = _round(table, Step(centroids, before), measure=done)
        if last is not None:
            discard(last)
        last, table = new, new.where("not tally")
        if done:
            break
        before, centroids = centroids, _moved(new, centroids)
    sums = {r.cluster: r.s for r in last.where("tally").groupBy("cluster").agg(F.sum("inertia").alias("s")).collect()}
    return table, centroids, [sums[j] for j in range(len(centroids))]
