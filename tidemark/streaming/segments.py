"""Keyed tables that grow by batches and stay cheap to look up: Parquet segments by hash buckets, and a manifest a batch.

A batch adds one small segment to each table. ``FANOUT`` segments of one level become one of the next, so a table has a few
segments for each order of size and a row is written anew once a level. A segment has as many buckets, a power of two, as
keep ``bucket_rows`` rows in each; a look-up of some keys opens their buckets in each segment and nothing else, however large
the table has become. The manifest of a batch is one file that names all segments of all tables. It is put in place by one
rename after everything it names has been written: a crash before leaves the state of the batch before, whole.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of one level that become one of the next.
FANOUT = 4
#: Rows that a bucket is meant to hold, and the most bits of a bucket's number. Beyond both (a billion rows) buckets grow.
BUCKET_ROWS, MOST_BITS = 250_000, 12


def bucket(by: Sequence[str], bits: int) -> Column:
    """Which of 2^bits buckets a row is in; buckets of fewer bits are unions of those of more."""
    return F.pmod(F.xxhash64(*by), F.lit(1 << bits)).cast("int")


class Table:
    """What a manifest keeps of one table: ``schema``, the columns ``by`` that it is looked up by, and its whole ``key``."""

    def __init__(self, name: str, schema: str, key: Sequence[str], by: Sequence[str] | None = None):
        self.name, self.schema, self.key, self.by = name, f"{schema}, batch bigint", list(key), list(by or key)
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def last(self, rows: DataFrame) -> DataFrame:
        """The last row of each key; it combines before the shuffle."""
        rest = [c for c in self.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest, "batch"), "batch").alias("r")).select(*self.key, "r.*")


class Segments:
    """The tables below ``path``. One writer; readers take the newest manifest and are not disturbed by it."""

    def __init__(self, spark: SparkSession, path: str, tables: Sequence[Table], bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows = spark, path, bucket_rows
        self.tables = {t.name: t for t in tables}

    # --- manifests

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def newest(self) -> int:
        """The last batch that has been committed, or -1."""
        fs, p = self._fs()
        folder = p(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=-1)

    def manifest(self, batch: int | None = None) -> dict:
        n = self.newest() if batch is None else batch
        if n < 0:
            return {"segments": {t: [] for t in self.tables}, "notes": {}}
        fs, p = self._fs()
        file = fs.open(p(f"{self.path}/manifests/{n:012d}.json"))
        try:
            return json.loads(bytes(file.readAllBytes()))
        finally:
            file.close()

    def notes(self) -> dict[int, dict]:
        """What came with each batch whose manifest is kept."""
        fs, p = self._fs()
        folder = p(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return {n: self.manifest(n)["notes"] for n in sorted(int(x.removesuffix(".json")) for x in names if x.endswith(".json"))}

    def bucketed(self, name: str) -> bool:
        return any(s["bits"] for s in self.manifest()["segments"][name])

    def commit(self, batch: int, rows: dict[str, DataFrame], expected: int, notes: dict) -> None:
        """Add ``rows`` of each table, about ``expected`` at most, as batch ``batch``, merge what has become too many
        segments, and switch to the result."""
        before = self.manifest()["segments"]

        def one(name: str) -> tuple[str, list[dict]]:
            t = self.tables[name]
            new = rows[name].select(*t.columns, F.lit(batch).cast("bigint").alias("batch"))
            return name, self._merged(t, [*before[name], self._segment(t, new, expected)])

        with ThreadPoolExecutor(len(rows)) as pool:  # the tables' jobs are independent and share the cluster
            segments = dict(pool.map(one, rows))
        fs, p = self._fs()
        draft = p(f"{self.path}/manifests/{batch:012d}.{uuid.uuid4().hex}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"segments": segments, "notes": notes}).encode()))
        out.close()
        if not fs.rename(draft, p(f"{self.path}/manifests/{batch:012d}.json")):
            raise RuntimeError(f"batch {batch} has been committed by another writer")

    def _segment(self, t: Table, rows: DataFrame, expected: int, level: int = 0) -> dict:
        """Rows written as a segment. A large one starts on the level that its size would have brought it to."""
        bits = min(MOST_BITS, max(0, (max(expected, 1) - 1) // self.bucket_rows).bit_length())
        path = f"segments/{t.name}-{uuid.uuid4().hex}"
        if bits:
            # rebalancing splits a bucket that one value fills over several tasks and files
            rows.withColumn("bucket", bucket(t.by, bits)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{path}")
        else:
            rows.hint("rebalance").write.parquet(f"{self.path}/{path}")
        written = {"path": path, "level": max(level, bits // 2), "bits": bits, "rows": 1}
        return written | {"rows": self._read(t, [written], None).count()}  # out of the files' footers

    def _merged(self, t: Table, segments: list[dict]) -> list[dict]:
        while True:
            level = min((x for x, n in Counter(s["level"] for s in segments).items() if n >= FANOUT), default=None)
            if level is None:
                return segments
            same = [s for s in segments if s["level"] == level]
            one = self._segment(t, t.last(self._read(t, same, None)), sum(s["rows"] for s in same), level + 1)
            segments = [s for s in segments if s["level"] != level] + [one]

    # --- reads

    def _read(self, t: Table, segments: list[dict], touched: list[int] | None) -> DataFrame:
        """Rows of segments; of buckets with numbers in ``touched`` (of MOST_BITS bits) alone, if it is given."""
        fs, p = self._fs()
        paths = []
        for s in segments:
            if not s["rows"]:
                continue
            wanted = {b % (1 << s["bits"]) for b in touched} if touched is not None else None
            if not s["bits"] or wanted is None or 2 * len(wanted) > 1 << s["bits"]:
                if wanted is None or wanted:
                    paths.append(f"{self.path}/{s['path']}")
                continue
            # buckets without rows have no folder
            there = {x.getPath().getName() for x in fs.listStatus(p(f"{self.path}/{s['path']}"))}
            paths += [f"{self.path}/{s['path']}/bucket={b}" for b in sorted(wanted) if f"bucket={b}" in there]
        if not paths:
            return self.spark.createDataFrame([], t.schema)
        return self.spark.read.schema(t.schema).option("recursiveFileLookup", "true").parquet(*paths)

    def all(self, name: str) -> DataFrame:
        """The last row of each key of a table."""
        t = self.tables[name]
        return t.last(self._read(t, self.manifest()["segments"][name], None)).select(*t.columns)

    def rows_for(self, name: str, asked: DataFrame) -> DataFrame:
        """All versions, with ``batch``, in the buckets that the values ``asked`` for (columns ``by``) fall into."""
        t = self.tables[name]
        segments = self.manifest()["segments"][name]
        touched = None
        if any(s["bits"] for s in segments):
            # at most 2^MOST_BITS numbers
            touched = [r[0] for r in asked.select(bucket(t.by, MOST_BITS)).distinct().collect()]
        return self._read(t, segments, touched)

    def look_up(self, name: str, asked: DataFrame) -> DataFrame:
        """The last row of each key whose columns ``by`` are among those of ``asked``."""
        t = self.tables[name]
        return t.last(self.rows_for(name, asked).join(asked.select(*t.by).distinct(), t.by, "left_semi")).select(*t.columns)

    def clean(self, keep: int = 2) -> int:
        """Delete what only manifests before the last ``keep`` name, and what writers that failed have left. Returns how many
        folders went. No batch may be written meanwhile, and no reader still be at an older manifest."""
        fs, p = self._fs()
        folder = p(f"{self.path}/manifests")
        if not fs.exists(folder):
            return 0
        files = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        kept = [f for f in files if f.endswith(".json")][-keep:]
        used = {s["path"] for f in kept for x in self.manifest(int(f.removesuffix(".json")))["segments"].values() for s in x}
        for f in files:
            if f not in kept:
                fs.delete(p(f"{self.path}/manifests/{f}"), False)
        gone = [s.getPath() for s in fs.listStatus(p(f"{self.path}/segments")) if f"segments/{s.getPath().getName()}" not in used]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
