"""Hard negatives by distributed radix selection over integer scores.

An anchor scores all rows by inner product. Its positives are the best rows of its own label; each positive opens a window of
scores, a fixed share of the positive's own, and the best rows of other labels inside that window are the negatives.

1. Positives: each cell of the grid below keeps its best rows of an anchor's label, and the best of these are the anchor's.
2. Selection: a score is written as its distance from the window's upper end. Digit by digit, from the highest, every cell
   counts the rows of a window that share the digits found so far by their next digit; the counts of all cells say which
   digit the kth row has and how many rows are still wanted inside it. A cell need not tell counts beyond the kth row of its
   own: they can't hold the kth row of all. After the last digit the kth score is known.
3. Gathering: rows of the window down to that score, of equal scores the smallest ids, and nothing else leave the cells.

On Spark: rows and anchors meet in a grid of blocks, ``ROWS`` by ``ANCHORS`` (``cogroup``): an anchor goes once to each block
of rows, a row once to each block of anchors, and inside a cell scores are computed in pieces of bounded size. Blocks are
dealt by a hash of the id, so neither a label nor a vector that a third of all rows have makes a large one. The work is that
of anchors times rows, as the question asks; what is shuffled is a small share of it, counts and rows that still matter.

Rows with a null id, label or vector, or a component that is null, non-finite or too large for exact scores
(``vectors.MOST_BITS``) take no part. Rows of one id count once: the one that sorts first by label, then vector. Vectors of
unequal lengths are filled up with zeros. Extra columns are ignored. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, first_of, in_cells, written
from .vectors import inner, matrix, scaled, usable

#: Rows and anchors of one cell, on average; scores of so many rows are in memory at a time.
ROWS, ANCHORS, PIECE = 512, 2048, 256
#: Bits of a digit.
DIGIT = 8
_WINDOW = "struct<positive: bigint, score: bigint, high: bigint, width: bigint, found: bigint, need: int>"


def prepared(vectors: DataFrame, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, label, v of the rows that take part, one for each id."""
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("x"))
    kept = rows.where("id is not null and label is not null").where(usable("x", scale)).select("id", F.struct("label", scaled("x", scale).alias("v")).alias("r"))
    return kept.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v")


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


class _Cell:
    """Scores of a cell, piece by piece."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        order = np.argsort(_numbers(rows, "id"))
        self.ids, self.labels, v = _numbers(rows, "id")[order], _numbers(rows, "label")[order], matrix(rows.column("v"))[order]
        self.anchor_ids, self.anchor_labels, w = _numbers(anchors, "id"), _numbers(anchors, "label"), matrix(anchors.column("v"))
        dims = max(v.shape[1], w.shape[1])
        self.v, self.w = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (v, w))

    def pieces(self):
        """Slice of rows, scores and equality of labels of anchors by rows."""
        for i in range(0, len(self.ids) if len(self.anchor_ids) else 0, PIECE):
            part = slice(i, i + PIECE)
            yield part, inner(self.w, self.v[part]), self.anchor_labels[:, None] == self.labels[None, part]


def _positives(k: int):
    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        cell = _Cell(rows, anchors)
        best = [np.empty(0, np.int64)] * 3
        for part, scores, same in cell.pieces():
            ids = cell.ids[part]
            s = np.where(same & (cell.anchor_ids[:, None] != ids[None, :]), scores, np.iinfo(np.int64).min)
            at = min(k, s.shape[1])
            least = np.partition(s, s.shape[1] - at, axis=1)[:, s.shape[1] - at]
            a, r = np.nonzero((s >= least[:, None]) & (s > np.iinfo(np.int64).min))
            best = [np.r_[x, y] for x, y in zip(best, (a, -s[a, r], ids[r]), strict=True)]
            keep = first_of(*best, k)
            best = [x[keep] for x in best]
        return pa.table({"anchor": cell.anchor_ids[best[0]], "id": best[2], "score": -best[1]}, schema=pa.schema([(n, pa.int64()) for n in ("anchor", "id", "score")]))

    return work


class _Windows:
    """The windows of a cell's anchors as matrices, anchors by windows; where an anchor has fewer, ``width`` is -1."""

    def __init__(self, anchors: pa.Table):
        lists = anchors.column("wins").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        at = np.arange(int(sizes.max(initial=0)))[None, :] < sizes[:, None]
        flat = lists.flatten()
        for name in ("positive", "score", "high", "width", "found", "need"):
            m = np.full(at.shape, -1 if name == "width" else 0, np.int64)
            m[at] = flat.field(name).to_numpy(zero_copy_only=False)
            setattr(self, name, m)


def _counts(shift: int):
    """Counts by the digit that begins at bit ``shift`` of the rows that share the higher digits found so far."""

    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        cell, wins = _Cell(rows, anchors), _Windows(anchors)
        n, most = wins.width.shape[1], 1 << DIGIT
        total = np.zeros((n, len(cell.anchor_ids), most), np.int64)
        for _, scores, same in cell.pieces():
            for w in range(n):
                off = wins.high[:, w, None] - scores
                a, r = np.nonzero(~same & (off >= 0) & (off <= wins.width[:, w, None]) & (off >> (shift + DIGIT) == wins.found[:, w, None]) & (wins.need[:, w, None] > 0))
                total[w] += np.bincount(a * most + (off[a, r] >> shift) % most, minlength=total[w].size).reshape(total[w].shape)
        before = np.cumsum(total, axis=2) - total
        w, a, digit = np.nonzero((total > 0) & (before < wins.need.T[:, :, None]))
        return pa.table({"anchor": cell.anchor_ids[a], "positive": wins.positive[a, w], "digit": digit.astype(np.int64), "n": total[w, a, digit]})

    return work


def _gathered(k: int):
    """The rows of each window down to the kth score; of each cell no more than k."""

    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        cell, wins = _Cell(rows, anchors), _Windows(anchors)
        out = [np.empty(0, np.int64)] * 5
        for w in range(wins.width.shape[1]):
            best = [np.empty(0, np.int64)] * 3
            for part, scores, same in cell.pieces():
                off = wins.high[:, w, None] - scores
                a, r = np.nonzero(~same & (off >= 0) & (off <= wins.found[:, w, None]) & (wins.width[:, w, None] >= 0))
                best = [np.r_[x, y] for x, y in zip(best, (a, off[a, r], cell.ids[part][r]), strict=True)]
                keep = first_of(*best, k)
                best = [x[keep] for x in best]
            a = best[0]
            out = [np.r_[x, y] for x, y in zip(out, (cell.anchor_ids[a], wins.positive[a, w], wins.score[a, w], best[2], wins.high[a, w] - best[1]), strict=True)]
        return pa.table(dict(zip(("anchor", "positive", "positive_score", "id", "score"), out, strict=True)))

    return work


def mined(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (id, label, v), whose anchors
    are those where ``anchors`` holds.

    A positive's window are the scores from half of its score to 19 twentieths, both included."""
    rows = written(rows, "scored")
    asked = written(rows.where(anchors), "anchors")
    counts = rows.count(), asked.count()
    met = lambda anchors, work, schema: in_cells(rows, anchors, ("id", "id"), counts, (ROWS, ANCHORS), work, schema)
    near = met(asked, _positives(positives), "anchor long, id long, score long")
    first = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives)
    low = F.expr("score div 2 + if(score > 0 and score % 2 = 1, 1, 0)")
    high = F.expr("score - score div 20 - if(score > 0 and score % 20 <> 0, 1, 0)")
    wide = best.select("anchor", F.col("id").alias("positive"), "score", high.alias("high"), (high - low).alias("width")).where("width >= 0")
    wins = written(wide.withColumn("found", F.lit(0).cast("long")).withColumn("need", F.lit(negatives)), "windows")
    widest = wins.agg(F.max("width")).first()[0] or 0
    for digit in reversed(range(max(1, -(-widest.bit_length() // DIGIT)))):
        counted = met(_with_windows(asked, wins), _counts(digit * DIGIT), "anchor long, positive long, digit long, n long")
        summed = counted.groupBy("anchor", "positive", "digit").agg(F.sum("n").alias("n"))
        so_far = summed.withColumn("upto", F.sum("n").over(W.partitionBy("anchor", "positive").orderBy("digit")))
        kth = wins.join(so_far, ["anchor", "positive"], "left").where("need > 0 and upto >= need and upto - n < need")
        chosen = kth.select("anchor", "positive", "digit", (F.col("need") - (F.col("upto") - F.col("n"))).cast("int").alias("left"))
        # a window that has fewer rows than wanted is taken whole: nothing is needed of it any more
        open_ = F.col("need") > 0
        found = F.when(~open_, F.col("found")).when(F.col("digit").isNull(), F.col("width")).otherwise(F.shiftleft("found", DIGIT) + F.col("digit"))
        need = F.when(open_, F.coalesce("left", F.lit(0))).otherwise(F.col("need"))
        new = written(wins.join(chosen, ["anchor", "positive"], "left").select("anchor", "positive", "score", "high", "width", found.alias("found"), need.alias("need")), "windows")
        discard(wins)
        wins = new
    got = met(_with_windows(asked, wins), _gathered(negatives), "anchor long, positive long, positive_score long, id long, score long")
    ranked = got.withColumn("rank", F.row_number().over(W.partitionBy("anchor", "positive").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _with_windows(anchors: DataFrame, wins: DataFrame) -> DataFrame:
    lists = wins.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("positive", "score", "high", "width", "found", "need")).cast(f"array<{_WINDOW}>").alias("wins"))
    return anchors.join(lists, "id")
