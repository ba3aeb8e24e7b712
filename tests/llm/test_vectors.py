"""Clustering, hard negatives and quality scores against brute force on small tables, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import centroids, negatives, quality, queries, vectors
from tidemark.llm.common import read

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, r int, g int, a string, cluster string, tally string, anchor string, x string, n string"


def clashing(rows):
    return [(*r, "id", "v", 1, 2, "a", "cluster", "tally", "anchor", "x", "n") for r in rows]


def vector_rows(n, dims, spread, seed, hot=0.3, labels=3):
    """Rows of few values, so that ties abound; ``hot`` of them are one vector."""
    rng = random.Random(seed)
    draw = lambda: [rng.randint(-spread, spread) / 16 for _ in range(dims)]
    same = draw()
    return [(i * 5, same if rng.random() < hot else draw(), rng.randrange(labels)) for i in range(n)]


ODD = [(None, [0.25] * 4, 1), (7, None, 1), (8, [], 1), (9, [0.5, None, 0.5, 0.5], 0), (10, [float("nan")] * 4, 0), (11, [float("inf")] * 4, 1), (12, [-float("inf"), 0.0, 0.0, 0.0], 1), (13, [0.5] * 3, 0), (14, [1e30] * 4, 1), (15, [0.1] * 4, None), (16, [0.5] * 4, 1), (16, [0.5] * 4, 1), (16, [0.75] * 4, 0), (50, [0.5] * 4, 1), (100, [0.5] * 4, 0), (150, [0.0] * 4, 2)]


def table(spark, rows):
    return spark.createDataFrame(clashing(rows), VECTORS).repartition(3)


# --- centroid clustering


def lloyd(rows, dims, k, rounds, salt, scale=1024):
    """(id, cluster, distance) of every kept row, and the centroids, with plain integers."""
    fine = lambda v: v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x) * scale <= 2**vectors.MOST_BITS for x in v)
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v, _ in rows if fine(v)]
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in by_hash[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], c


@pytest.mark.parametrize(("rows", "k", "rounds"), [(vector_rows(150, 4, 9, 1), 5, 6), (vector_rows(60, 4, 2, 2), 8, 10), (vector_rows(90, 4, 40, 3, hot=0), 3, 4), (vector_rows(5, 4, 9, 4), 8, 3), (vector_rows(40, 4, 9, 5), 1, 2), (ODD, 3, 4), (ODD * 3, 4, 0)])
def test_clusters_are_lloyd_s(spark, rows, k, rounds):
    got, final, sums = centroids.clustered(centroids.prepared(table(spark, rows), dims=4), k, rounds)
    want, c = lloyd(rows, 4, k, rounds, "3:")
    got = [(r.id, r.cluster, r.distance) for r in got.collect()]
    none_first = lambda r: (r[0] is not None, r)
    assert sorted(got, key=none_first) == sorted(want, key=none_first)
    assert final == c
    assert sums == [sum(d for _, o, d in want if o == j) for j in range(len(c))]


def test_bounds_spare_scans_and_hold():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(m, 60, (200, 8)) for m in (0, 500, 1500, 4000)]).astype(np.int64)
    c, before = v[[1, 200, 450, 700]], None
    cluster, upper, lower = np.zeros(len(v), np.int64), np.full(len(v), centroids.FAR), np.full(len(v), -1)
    scans = []
    for _ in range(6):
        cluster, upper, lower, scanned = centroids.Step(c.tolist(), before).assign(v, cluster, upper, lower)
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        own = d[np.arange(len(v)), cluster]
        assert (cluster == d.argmin(1)).all()
        assert (upper.astype(float) ** 2 >= own).all()
        assert (np.where(lower < 0, 0, lower) ** 2 <= np.sort(d, 1)[:, 1]).all()
        scans.append(int(scanned.sum()))
        before, c = c.tolist(), np.array([v[cluster == j].sum(0) // (cluster == j).sum() for j in range(4)])
    assert scans[0] > len(v) / 2  # the first centroid keeps the vectors near it
    assert scans[-1] < len(v) / 20


def test_roots():
    x = np.array([0, 1, 2, 3, 4, 2**52, 2**52 - 1, 2**60, 2**60 - 1, 2**60 + 1, 2**62], np.int64)
    down, up = centroids.root_down(x), centroids.root_up(x)
    assert all(int(a) ** 2 <= int(y) < (int(a) + 1) ** 2 for a, y in zip(down, x, strict=True))
    assert all(int(b) ** 2 >= int(y) > (int(b) - 1) ** 2 or y == 0 == b for b, y in zip(up, x, strict=True))


def test_no_vectors(spark):
    none = table(spark, ODD).where("false")
    got, final, sums = centroids.clustered(centroids.prepared(none, dims=4))
    assert (got.count(), final, sums) == (0, [], [])
    assert negatives.mined(negatives.prepared(none), vectors.F.col("id") % 50 == 0).count() == 0


def test_inner_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (2**8, 2**27):
        a, b = rng.integers(-most, most, (7, 64)), rng.integers(-most, most, (5, 64))
        assert vectors.inner(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]


# --- hard negatives


def mined(rows, anchor, positives, least, scale=256):
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) and abs(x) * scale <= 2**vectors.MOST_BITS for x in v)
    by_id = {}
    for i, v, label in rows:
        if i is not None and label is not None and fine(v):
            r = (label, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v])
            by_id[i] = min(by_id.get(i, r), r)
    out = []
    for a, (label, v) in by_id.items():
        if not anchor(a):
            continue
        score = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, (_, w) in by_id.items() if i != a)
        best = [(i, -s) for s, i in score if by_id[i][0] == label][:positives]
        for p, ps in best:
            found = [(i, -s) for s, i in score if by_id[i][0] != label and 50 * ps <= 100 * -s <= 95 * ps][:least]
            out += [(a, p, n + 1, i, ps, s) for n, (i, s) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("rows", "positives", "least"), [(vector_rows(200, 4, 9, 1), 5, 3), (vector_rows(200, 4, 2, 2), 5, 3), (vector_rows(300, 6, 3000, 3, hot=0, labels=2), 4, 7), (vector_rows(120, 3, 1, 4, hot=0.6), 5, 3), (vector_rows(60, 4, 9, 5, labels=1), 5, 3), (ODD * 2, 5, 3), (vector_rows(700, 4, 30, 6, hot=0.4), 5, 3)])
def test_negatives_are_those_of_a_full_sort(spark, rows, positives, least, monkeypatch):
    monkeypatch.setattr(negatives, "PIECE", 37)
    monkeypatch.setattr(negatives, "ROWS", 64)
    got = negatives.mined(negatives.prepared(table(spark, rows)), vectors.F.col("id") % 50 == 0, positives, least)
    assert sorted(map(tuple, got.collect())) == mined(rows, lambda i: i % 50 == 0, positives, least)


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_hard_negatives"])
def test_vector_queries_are_their_sql_s(spark, sf_dir, name):
    import oracle

    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), oracle.connection(sf_dir), queries.ORACLE_SQL[name]) == ""


# --- quality


def test_trees_go_down_as_row_by_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x, y)
    for row, raw in zip(x[:50], trees.raw(x[:50]), strict=True):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.statistic[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        assert raw == pytest.approx(total)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.97


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (80, 3)).astype(float), rng.integers(0, 2, 80).astype(float)
    trees = quality.fit(x, y)
    g, h = y.mean() - y, np.full(80, y.mean() * (1 - y.mean()))
    gains = {}
    for j in range(3):
        for t in np.unique(x[:, j])[:-1] + 0.5:
            left = x[:, j] <= t
            if min(left.sum(), (~left).sum()) >= quality.LEAST:
                gains[j, t] = sum(g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + quality.RIDGE)
    at = trees.roots[0]
    assert gains[trees.statistic[at], trees.threshold[at]] == pytest.approx(max(gains.values()))


def test_statistics():
    x = dict(zip(quality.NAMES, quality.statistics("Ab ab ab, CD!! | ok.\n\nx\nx"), strict=True))
    assert (x["repeats"], x["lines_distinct"], x["word_top"], x["capitals"]) == pytest.approx((1 / 8, 2 / 3, 2 / 8, 1 / 8))
    assert (x["odd_ends"], x["bare_symbols"], x["one_letter"], x["lines_stopped"]) == pytest.approx((2 / 8, 1 / 8, 3 / 8, 1 / 3))
    assert np.expm1(x["longest_run"]) == pytest.approx(2)
    assert quality.statistics("") == quality.statistics(" \n ") == [0.0] * len(quality.NAMES)
    assert len(quality.statistics("a")) == len(quality.NAMES)


def labelled(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
    good = lambda: " ".join(f"{word()} {word()}, {word()} {word()}." for _ in range(rng.randint(5, 60)))
    bad = lambda: " | ".join(word() for _ in range(rng.randint(20, 90)))
    rows = [(i, bad() if i % 4 == 0 else good(), int(i % 4 != 0)) for i in range(400)]
    return rows, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")


def test_quality_of_held_out_rows(spark):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double").repartition(3)
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == (got[i].score >= 0.5) for i, _, _ in rows)
    assert np.mean([got[i].predicted == q for i, _, q in rows if got[i].held_out]) > 0.97
    # labels of held-out rows change nothing, nor do the other columns
    turned = spark.createDataFrame([(i, 1 - q if got[i].held_out else q) for i, _, q in rows], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in quality.scored(docs.selectExpr("doc_id", "text", "'xx' as lang"), turned).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_quality_of_odd_rows(spark):
    rows, labels = labelled(spark)
    odd = [(None, "no id at all"), (1, None), (2, ""), (3, " \n\n "), (3, "|" * 100_000), (3, "ab " * 100_000), (3, "ab " * 100_000), (5, "\U0001f600\u0007 é" * 9)]
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows] + [(*r, "c") for r in odd], "doc_id long, text string, h string")
    got = quality.scored(docs, labels.unionByName(spark.createDataFrame([(None, 1), (2, None), (7, 0)], "doc_id long, quality int"))).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    twice = [r.score for r in got if r.doc_id == 3]
    assert len(twice) == 5 and max(twice.count(s) for s in twice) >= 2
    none = docs.where("false")
    assert quality.scored(none, labels).count() == 0
    assert {r.score for r in quality.scored(docs, labels.where("false")).collect()} == {0.5}


def test_quality_of_the_driver_s_held_out_rows(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = quality.scored(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.8


# --- reading all codes in place of endless look-ups


@pytest.mark.parametrize("scanned", [0, 16, 10**9])
def test_far_queries_read_the_codes(spark, monkeypatch, scanned):
    """Whether a radius is looked up or all codes are read, and where the one goes over into the other, changes no result."""
    from tidemark.llm import hamming

    rng = random.Random(9)
    hot = rng.getrandbits(63)
    rows = [(i, hot if i % 3 == 0 else (hot ^ (1 << rng.randrange(60))) if i % 3 == 1 else rng.getrandbits(63)) for i in range(240)] + [(1000, ~hot & (2**63 - 1)), (1001, 0)]
    if scanned == 0:  # without reading, far queries list all masks: short codes keep that small
        rows = [(i, c & 0xFF) for i, c in rows]
    monkeypatch.setattr(hamming, "SCANNED", scanned)
    monkeypatch.setattr(hamming, "PIECE", 33)
    monkeypatch.setattr(hamming, "CELL", (50, 20))
    codes = spark.createDataFrame(rows, "id long, code long").repartition(3)
    asked = codes.where("id % 20 = 0 or id >= 1000")
    want = []
    for q, code in rows:
        if q % 20 == 0 or q >= 1000:
            near = sorted(((code ^ c).bit_count(), i) for i, c in rows if i != q)[:7]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert sorted(map(tuple, hamming.top_k(codes, asked, k=7).collect())) == sorted(want)


def test_segments_keep_their_bound():
    from tidemark.llm import hamming

    for n in (1, 1000, 2**25, 2**26, 2**40):
        cut = hamming.segments(n)
        assert max(bits for _, bits in cut) <= hamming.MOST_BITS
        assert [a for a, _ in cut] == [0, *np.cumsum([b for _, b in cut])[:-1]] and sum(b for _, b in cut) == 64
