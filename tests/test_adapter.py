"""The data source of operators' files: refusals, and batches and streams of one folder."""

import json
import os

from tidemark.sources.adapter import SCHEMA, ManualFiles, items_of

FILES = {
    "a.json": {"gameId": "lol", "items": [{"title": "한"}, {"title": "b"}]},
    "b.json": {"gameId": "wuwa", "items": [{"title": "c"}]},
    "c.json": {"gameId": "lol", "items": []},
    "d.json": {"gameId": "lol", "items": [{"n": i} for i in range(201)]},
    "e.json": {"gameId": "lol", "items": [{"n": i} for i in range(200)]},
    "f.json": [1],
    "_hidden.json": {"gameId": "lol", "items": [1]},
}


def test_items_of_a_file():
    reason = lambda f: items_of(json.dumps(f), "lol")[0][2]
    assert [reason(FILES[f"{x}.json"]) for x in "abcdef"] == [None, "another game", "no items", "too many items", None, "unexpected shape"]
    assert items_of("{", "lol") == items_of("", "lol") == items_of('{"gameId": "lol"}', "lol") == [(None, None, "unexpected shape")]
    assert items_of(json.dumps(FILES["a.json"]), "lol") == [(0, '{"title": "한"}', None), (1, '{"title": "b"}', None)]


def test_batch_and_stream_agree(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    (folder / "deep").mkdir(parents=True)
    spark.dataSource.register(ManualFiles)
    options = {"game": "lol", "filesPerPartition": "2"}
    path = f"file://{folder}"

    def put(name, file, at):
        (folder / name).write_text(json.dumps(file, ensure_ascii=False), encoding="utf-8")
        os.utime(folder / name, (at, at))

    def batch():
        return sorted(map(repr, spark.read.format("manual_files").options(**options).load(path).collect()))

    def stream():
        rows = spark.readStream.format("manual_files").options(**options).load(path)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(repr, spark.read.schema(SCHEMA).parquet(out).collect()))

    assert batch() == []
    for i, (name, file) in enumerate(FILES.items()):
        put(name, file, 1000 + i // 2)  # some at one time
    first = batch()
    assert len(first) == 2 + 200 + 4 and stream() == first
    put("deep/g.json", {"gameId": "lol", "items": [{"title": "later"}]}, 2000)
    assert len(batch()) == len(first) + 1 and stream() == batch()
    assert stream() == batch()  # nothing new
