"""Operators' files as a data source of its own, for batches and for streams.

    spark.dataSource.register(ManualFiles)
    spark.read.format("manual_files").option("game", "lol").load(path)
    spark.readStream.format("manual_files").option("game", "lol").load(path)

Discovery lists the files below ``path`` and deals them to partitions; a task fetches its files one after the other and holds
one of them at a time. A file is refused as a whole, in one row with a reason, if it is no object with a list of items, is of
another game than the one asked for, or has no item or more than MANUAL_MOST. Otherwise each item is a row, as JSON.

A stream's offset is the modification time and path of the last file that has been read, so a batch that runs again reads
the same files. Files have to be moved into the folder whole, and with times that do not go back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .feeds import MANUAL_MOST

SCHEMA = "document_key string, position int, item string, reason string"
#: Files that one partition fetches.
FILES = 64


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def items_of(text: str, game: str) -> list[tuple[int | None, str | None, str | None]]:
    """(position, item, reason) of a file's text."""
    refused = lambda reason: [(None, None, reason)]
    try:
        file = json.loads(text)
    except ValueError:
        return refused("unexpected shape")
    if not isinstance(file, dict) or not isinstance(file.get("items"), list):
        return refused("unexpected shape")
    if file.get("gameId") != game:
        return refused("another game")
    if not file["items"]:
        return refused("no items")
    if len(file["items"]) > MANUAL_MOST:
        return refused("too many items")
    return [(i, json.dumps(x, ensure_ascii=False), None) for i, x in enumerate(file["items"])]


class _Adapter:
    """Discovery and fetching, the same for batches and streams."""

    def __init__(self, options: dict[str, str]):
        self.path, self.game = options["path"], options["game"]
        self.files = int(options.get("filesPerPartition", str(FILES)))

    def discover(self) -> list[tuple[int, str]]:
        """Modification time (ns) and path of every file, in this order; names with ``_`` or ``.`` in front are none."""
        system, root = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and f.base_name[0] not in "_.")

    def dealt(self, paths: list[str]) -> list[Files]:
        return [Files(paths[i : i + self.files]) for i in range(0, len(paths), self.files)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            key = path.removeprefix(root).lstrip("/")
            yield from ((key, *row) for row in items_of(text, self.game))


class _Batch(_Adapter, DataSourceReader):
    def partitions(self) -> list[Files]:
        # without a partition Spark would ask for one that has no files
        return self.dealt([path for _, path in self.discover()]) or [Files([])]


class _Stream(_Adapter, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.discover()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, last = ((x["time"], x["path"]) for x in (start, end))
        return self.dealt([f[1] for f in self.discover() if after < f <= last])

    def commit(self, end: dict) -> None:
        """Nothing is kept that could be let go."""


class ManualFiles(DataSource):
    """Options: ``path``, a folder as URI; ``game``, the one asked for; ``filesPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "manual_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
