"""Chunks of lines against a chunker and a dedup of their own, line by line."""

from __future__ import annotations

import random

import pytest
import xxhash

from tidemark.llm import lines


def plain_chunks(text):
    """The chunks of a text: cuts after every second line of a least pair, around runs, and after 32 lines."""
    rows = text.split("\n")
    if len(rows) < 4:
        return [rows]
    h = [xxhash.xxh64_intdigest(x) for x in rows]
    pair = []
    for a, b in zip(h, h[1:], strict=False):
        x = (a * 0x9E3779B97F4A7C15 + b) % 2**64
        x ^= x >> 31
        pair.append(x * 0xBF58476D1CE4E5B9 % 2**64)
    cuts = set()
    for i in range(1, len(pair) - 1):
        if pair[i - 1] > pair[i] < pair[i + 1]:
            cuts.add(i + 1)
    i = 0
    while i < len(pair):
        j = i
        while j + 1 < len(pair) and pair[j + 1] == pair[i]:
            j += 1
        if j > i:  # the lines i to j + 1 are equal
            cuts |= {i, j + 2}
        i = j + 1
    out, now = [], []
    for i, row in enumerate(rows):
        if now and (i in cuts or len(now) == 32):
            out.append(now)
            now = []
        now.append(row)
    return [*out, now]


def plain_dedup(texts):
    seen, out = set(), []
    for text in texts:
        kept = []
        for chunk in plain_chunks(text):
            body = "\n".join(chunk)
            if sum(bool(x.strip()) for x in chunk) > 1:
                if body in seen:
                    continue
                seen.add(body)
            kept += chunk
        out.append("\n".join(kept))
    return out


def prose(rng, n):
    return [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(6)) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_is_the_plain_one(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, rng.randint(3, 40)) for _ in range(5)] + [["=" * 9] * n for n in (2, 3, 50, 300)] + [["a", "b"] * 30, [""] * 20]
    texts = []
    for _ in range(40):
        part = [prose(rng, rng.randint(0, 9)), rng.choice(shared), prose(rng, rng.randint(0, 9)), rng.choice(shared), prose(rng, rng.randint(0, 3))]
        texts.append("\n".join(x for p in part for x in p))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in lines.deduplicated(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain_dedup(texts)


def test_a_run_of_one_line_is_found_between_any_neighbours(spark):
    rng = random.Random(3)
    run = ["-- * --"] * 300
    texts = ["\n".join([*prose(rng, 3), *run, *prose(rng, 2)]), "\n".join([*prose(rng, 5), *run, *prose(rng, 4)]), "\n".join([*prose(rng, 1), *run[:200], *prose(rng, 2)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lines.deduplicated(docs, counts=True).collect()}
    # the first 32 lines and the last 12 stay where they come first, what a run repeats of itself goes too
    assert [got[i].removed_lines for i in range(3)] == [256, 300, 192]


@pytest.mark.parametrize("text", ["", "a", "\n\n\n", "x\n" * 500, "a\nb\n" * 100, "\n".join(map(str, range(500)))])
def test_chunks_cover_and_have_a_bound(text):
    rows = text.split("\n")
    bounds = lines.chunk_bounds(rows)
    assert [x for a, b in bounds for x in rows[a:b]] == rows
    assert all(0 < b - a <= lines.MOST for a, b in bounds)
    assert [rows[a:b] for a, b in bounds] == plain_chunks(text)
