"""Near-duplicates by SimHash fingerprints: pigeonhole blocks, verified Hamming distance, connected groups.

Work is done on distinct fingerprints, so a group of exact copies is one row. A fingerprint is split into ``blocks``; two
within ``distance`` bits agree on ``blocks - distance`` whole blocks, so rows meet on each such choice of blocks and the
distance is verified in the join's condition. The number of blocks follows the number of fingerprints: a key always has
more bits than it takes to number them, so that chance meetings stay few at any size.

A key that many fingerprints share is not joined with itself: one task compares them on arrays and gives back a spanning
forest of the links that it found, which keeps every group whole with fewer rows than it was given. A key of more than
``TILE`` fingerprints is cut first by finer blocks: the bits that it leaves free are split in their turn, and two within
``distance`` agree on some of these blocks too. Only what then still shares a key in such numbers, near copies that differ
nowhere else, is dealt into tiles that meet in pairs.

Null text counts as empty; all documents without words have fingerprint zero and are linked like any other. Repeated rows
come back as often as they occur. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, written
from .components import connected_components

WORDS = 4
DISTANCE = 4
SEED = 42
#: Fingerprints of one key up to which the key is joined with itself; beyond, in tiles of TILE.
SMALL, TILE = 48, 2048


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit i is 1 if more than half of the shingles' hashes have it."""
    # bytes.lower() and bytes.split() know ASCII alone: A-Z, space and \x09-\x0D
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(begins[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            got = np.array([fingerprint(t or "", words) for t in step["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(step["doc_id"], pa.int64()), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """The bits of each choice of ``blocks - distance`` blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(bits, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks whose keys have 3 bits more than it takes to number ``n`` fingerprints."""
    blocks = distance + 2
    while 64 * (blocks - distance) // blocks < n.bit_length() + 3 and blocks < distance + 6:
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between ``a`` and ``b`` (one array twice: within it)."""
    values = np.unique(np.concatenate((a, b)))
    group = np.arange(len(values))  # of each value: the least index in its tree so far
    of_a, of_b = np.searchsorted(values, a), np.searchsorted(values, b)
    found = []
    for i in range(0, len(a), 256):
        near = np.bitwise_count((a[i : i + 256, None] ^ b[None, :]).view(np.uint64)) <= distance
        for x, links in zip(of_a[i : i + 256].tolist(), near, strict=True):
            there = of_b[links]
            trees, at = np.unique(group[there], return_index=True)
            other = trees != group[x]
            if other.any():
                found += [(int(values[x]), int(values[y])) for y in there[at[other]].tolist()]
                trees = np.append(trees, group[x])
                group[np.isin(group, trees)] = trees.min()
    return found


def finer_masks(masks: list[int], distance: int) -> list[tuple[int, int]]:
    """(choice, bits) of each choice of blocks: its own bits and those of each choice of two out of ``distance + 2`` blocks of
    the bits that it leaves free."""
    out = []
    for choice, mask in enumerate(masks):
        free = [1 << i for i in range(64) if not mask >> i & 1]
        edges = [len(free) * i // (distance + 2) for i in range(distance + 3)]
        parts = [sum(free[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        out += [(choice, mask | x | y) for x, y in combinations(parts, 2)]
    return out


def _counted(keyed: DataFrame, name: str) -> DataFrame:
    """choice, key, fp of keys that several fingerprints share, with their count."""
    counts = keyed.groupBy("choice", "key").count().where("count > 1")
    # Spark takes a row exploded into one for each choice for a single one: without the hint it would broadcast millions of rows
    return written(keyed.join(counts.hint("merge"), ["choice", "key"]), name)


def links(distinct: DataFrame, distance: int = DISTANCE, small: int = SMALL, tile: int = TILE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect every group of fingerprints within ``distance``.

    All links of keys with up to ``small`` fingerprints; of larger keys a spanning forest of all their links.
    """
    n = distinct.count()
    masks = block_masks(blocks_for(n, distance), distance)
    keyed = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k"), "fp").select("k.*", "fp")
    shared = _counted(keyed, "blocks")
    # a constant table: its size depends on the number of choices alone
    rows = [(choice, len(masks) + i, _signed(m)) for i, (choice, m) in enumerate(finer_masks(masks, distance))]
    table = F.broadcast(distinct.sparkSession.createDataFrame(rows, "choice int, finer int, mask long"))
    hot = shared.where(F.col("count") > tile).join(table, "choice").select(F.col("finer").alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    shared = shared.where(F.col("count") <= tile).unionByName(_counted(hot, "finer"))
    few = shared.where(F.col("count") <= small).drop("count")
    near = (F.col("x.choice") == F.col("y.choice")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance)
    # by sort and merge: Parquet packs these rows so well that Spark would broadcast hundreds of thousands of them
    direct = few.alias("x").join(few.alias("y").hint("merge"), near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    # the rows of a large key fall into tiles by a hash; each tile meets every tile of its key once
    tiles = F.ceil(F.col("count") / tile).cast("int")
    many = shared.where(F.col("count") > small).withColumn("own", F.pmod(F.xxhash64("fp"), tiles).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    many = many.select("choice", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "fp")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        p, q = group["p"].iloc[0], group["q"].iloc[0]
        fp = np.sort(group["fp"].to_numpy()[group["own"] == p])
        found = _forest(fp, fp if p == q else np.sort(group["fp"].to_numpy()[group["own"] == q]), distance)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return direct.union(many.groupBy("choice", "key", "p", "q").applyInPandas(run, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable) of every row."""
    prints = written(fingerprints(docs, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = connected_components(links(distinct.select("fp"), distance))
    # a component's id is the smallest document of all its fingerprints; tables with a row a fingerprint are never broadcast
    named = distinct.join(groups.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    named = written(named.select("fp", "first", F.coalesce("component", "fp").alias("component")), "groups")
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    fps = named.join(ids.hint("merge"), "component").select("fp", "component_id")
    return prints.join(fps.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each group only. Its rows with that doc_id all stay."""
    kept = near_duplicates(docs, words, distance).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
