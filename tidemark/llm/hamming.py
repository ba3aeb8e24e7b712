"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments; a table for each segment maps its value to codes. A query looks up values at distance 0 from
its own in each segment, then at distance 1, and so on. Having searched the first ``a + 1`` segments to radius ``r`` and the
others to ``r - 1``, it has met every code within ``m * r + a`` bits, so it stops when its kth verified distance is no
larger: growing radii, exact results, ties by id included. Where a radius would look up so many values that reading all
codes is cheaper, the queries that are still open do that instead: far queries list no endless masks.

On Spark: equal codes are one entry with its smallest ids. The tables of all segments are one table (segment, value, code),
built and written once. A round takes one radius: the queries that are still open name the values they look up, these rows
meet the table in an equi-join, the distance is verified in its condition, and a query keeps its k best. A query whose kth
distance the rounds so far cover leaves. The segments have as many bits as it takes to number the entries, so a value has
about one entry at any size, and what is shuffled grows with codes and look-ups. Where near codes crowd one value, the join's
partition is split by adaptive execution; its pairs are those that the search has to verify.

Rows with a null id or a null or empty vector have no code and are left out. Repeated rows count once. Extra columns are
ignored. An empty table gives no rows; with fewer than k other rows a query has them all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import first_of, in_cells, written

BITS = 64
#: Bits of a segment at most: no more values are listed for one query and segment than its powers of two.
MOST_BITS = 26
#: Codes that are compared in the time of one look-up, about: a radius with more look-ups than that share of the entries is
#: not searched, the entries are read. And how many entries and queries meet in one cell, and in one step of it.
SCANNED = 16
CELL, PIECE = (2048, 1024), 512
#: Look-ups that one batch of a task holds, and that one task is dealt.
PROBES = 250_000


def binary_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, code: bit i is 1 if the components i, i + 64, ... of the vector sum to more than 0."""
    v = F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    one = F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (code, i) -> code | if(aggregate(sequence(i, greatest(i, size(v) - 1), {BITS}), 0D, (s, j) -> s + coalesce(get(v, j), 0D)) > 0, shiftleft(1L, i), 0L))")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    return rows.select("id", one.alias("code"))


def segments(entries: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each segment: about as many bits as it takes to number the entries."""
    m = max(2, -(-BITS // min(MOST_BITS, max(4, int(entries).bit_length()))))
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _part(code: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << bits) - 1))


def probes(queries: DataFrame, cut: list[tuple[int, int]], radii: range) -> DataFrame:
    """query, bound, seg, step, value of ``queries`` (query, bound): every value at one of ``radii`` bits from the query's own,
    in each segment; ``step`` numbers pairs of a radius and a segment in the order of the search."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, bounds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for (seg, (first, bits)), radius in product(enumerate(cut), radii):
                masks = np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)
                wide = max(1, PROBES // max(1, len(masks)))
                for i in range(0, len(codes) if len(masks) else 0, wide):
                    q = codes[i : i + wide]
                    own = ((q.view(np.uint64) >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                    values = (own[:, None] ^ masks[None, :]).ravel()
                    cols = [np.repeat(q, len(masks)), np.repeat(bounds[i : i + wide], len(masks)), np.full(len(values), seg, np.int8), np.full(len(values), radius * len(cut) + seg, np.int32), values]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "bound", "seg", "step", "value"])

    return queries.select("query", "bound").mapInArrow(run, "query long, bound int, seg tinyint, step int, value long")


def _nearest_of_all(k: int):
    """The ``k`` nearest codes of a cell for each of its queries, by (distance, first)."""

    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        codes, firsts, queries = (t.column(n).to_numpy().astype(np.int64) for t, n in ((rows, "code"), (rows, "first"), (asked, "query")))
        best = [np.empty(0, np.int64)] * 4
        for i in range(0, len(codes) if len(queries) else 0, PIECE):
            far = np.bitwise_count(queries.view(np.uint64)[:, None] ^ codes.view(np.uint64)[None, i : i + PIECE])
            at = min(k, far.shape[1]) - 1
            q, c = np.nonzero(far <= np.partition(far, at, axis=1)[:, at, None])
            best = [np.r_[x, y] for x, y in zip(best, (q, far[q, c].astype(np.int64), firsts[i + c], codes[i + c]), strict=True)]
            keep = first_of(*best[:3], k)
            best = [x[keep] for x in best]
        return pa.table({"query": queries[best[0]], "code": best[3], "distance": best[1].astype(np.int32), "first": best[2]})

    return work


def search(entries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, code, distance, first of the k nearest entries (code, first) by (distance, first) of each code in ``asked``
    (query). With fewer than k entries, all of them."""
    total = entries.count()
    need = min(k, total)
    cut = segments(total)
    m = len(cut)
    rows = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("seg"), _part(F.col("code"), *c).alias("value")) for i, c in enumerate(cut)])
    table = None
    nearest = W.partitionBy("query").orderBy("distance", "first")
    total_asked = queries = asked.count()
    best, open_, radius = None, asked.withColumn("bound", F.lit(BITS)), 0
    while need and radius <= max(bits for _, bits in cut):
        # the first two radii cost little and cover nobody alone: one round
        radii = range(radius, radius + (2 if radius == 0 else 1))
        looks = sum(comb(bits, r) for _, bits in cut for r in radii)
        if looks * SCANNED > total:
            near = in_cells(entries, open_.select("query"), ("code", "query"), (total, queries), CELL, _nearest_of_all(need), "query long, code long, distance int, first long")
            rest = near.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).drop("n")
            return rest if best is None else best.join(open_.select("query"), "query", "left_anti").unionByName(rest)
        if table is None:
            table = written(entries.select("code", "first", F.explode(rows).alias("s")).select("s.seg", "s.value", "code", "first"), "segments")
        x = F.col("query").bitwiseXOR(F.col("code"))
        # a pair is met in every segment that is near enough: it counts in the first one of the least distance alone
        met = F.least(*[F.bit_count(_part(x, *c)) * m + i for i, c in enumerate(cut)])
        dealt = open_.repartition(max(1, -(-queries * looks // PROBES)), "query")
        pairs = probes(dealt, cut, radii).join(table.hint("merge"), ["seg", "value"]).where((F.bit_count(x) <= F.col("bound")) & (met == F.col("step")))
        new = pairs.select("query", "code", F.bit_count(x).cast("int").alias("distance"), "first")
        every = new if best is None else best.unionByName(new)
        best = written(every.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k).drop("n"), "nearest")
        # all segments are now searched to this radius: every code within m * (radius + 1) - 1 bits has been met
        radius = radii.stop
        kth = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("last")).where(F.col("n") == need).select("query", "last")
        done = kth.where(F.col("last") <= m * radius - 1)
        left = total_asked - done.count()
        if not left:
            break
        # farther codes than the kth so far are none of the nearest: they are dropped where they are met
        bound = F.coalesce("last", F.lit(BITS))
        queries, open_ = left, asked.join(kth, "query", "left").select("query", bound.alias("bound"), F.coalesce(F.col("last") <= m * radius - 1, F.lit(False)).alias("done")).where("not done")
    return best if best is not None else entries.where("false").select(F.col("code").alias("query"), "code", F.lit(0).alias("distance"), "first")


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance: the k nearest other rows by (distance, id) of each query.

    ``codes`` and ``queries`` have id and code; a query's own id is never its neighbour.
    """
    most = k + 1  # one may be the query itself
    by_code = W.partitionBy("code").orderBy("id")
    nearest_ids = codes.distinct().withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= most)
    entries = written(nearest_ids.groupBy("code").agg(F.min("id").alias("first"), F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = written(queries.select(F.col("code").alias("query")).distinct(), "asked")
    near = search(entries.select("code", "first"), asked, most)
    rows = near.join(entries.select("code", "ids"), "code").select("query", "distance", F.explode("ids").alias("neighbor_id"))
    # equal queries share this list; it has one row more than any of them needs
    shared = rows.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy("distance", "neighbor_id"))).where(F.col("n") <= most)
    lists = shared.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))).alias("near"))
    own = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct().join(lists, "query")
    kept = F.slice(F.filter("near", lambda x: x["neighbor_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(kept).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.neighbor_id", F.col("x.distance").cast("int").alias("distance"))
