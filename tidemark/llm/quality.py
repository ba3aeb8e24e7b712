"""Quality scores of whole texts: histogram gradient-boosted trees over document statistics.

1. Statistics. Each text becomes a row of numbers (``NAMES``): shares of kinds of characters, lengths and repetition of words,
   shapes of lines, and the worst line of the text, so that a stretch of junk inside a clean text shows.
2. Learning. A bounded sample of labelled training rows (``MOST_LABELLED``; equal texts count once) gives the statistics'
   quantile bins. Trees are grown level by level on histograms of gradients per bin, a split where it lowers the logistic loss
   most. The sample is all that comes to the driver.
3. Scoring. All trees are one set of flat arrays (statistic, threshold, left, right, value). A batch of rows goes down all
   trees at once, one numpy step a level.

Labels are read only for rows whose crc32(doc_id as text) mod 3 is not 1. Labels, language, source and doc_id are never inputs
of a score. Null text counts as empty; an empty text has zeros for statistics and is scored like any other. Repeated rows are
scored each; of several texts of one doc_id learning takes the one that sorts first, of several labels the largest. Rows with
a null doc_id are scored and not held out. Extra columns are ignored. An empty table gives no rows. Without usable labels
(none, or one class) every text scores the share of class 1, a half if there is none.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_CHARS, steps, written

#: Labelled training rows that learning uses at most (rows are taken in the order of a hash of doc_id).
MOST_LABELLED = 20_000
THRESHOLD = 0.5
#: Trees, their levels, the step each makes, bins of a statistic, least rows of a leaf, ridge of leaf values.
TREES, LEVELS, RATE, BINS, LEAST, RIDGE = 80, 4, 0.15, 64, 8, 1.0
#: Words of the shortest line that can be a text's worst line.
LINE_WORDS = 4
NAMES = (
    ["chars", "words", "lines", "lower", "upper", "digits", "spaces", "stops", "symbols", "foreign", "entropy", "common_char"]
    + ["word_mean", "word_std", "word_max", "words_distinct", "word_top", "pairs_distinct", "repeats", "longest_run", "capitals", "odd_ends", "bare_symbols", "one_letter"]
    + ["lines_distinct", "line_words", "line_words_max", "lines_stopped", "line_repeats", "line_capitals", "line_odd_ends", "line_bare", "line_symbols"]
)
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _FOREIGN = range(7)
_TABLE = 0x3000


def _kind(c: str) -> int:
    general = unicodedata.category(c)
    if general == "Lu":
        return _UPPER
    if general[0] in "LM":
        return _LOWER
    if general[0] == "N":
        return _DIGIT
    if c.isspace():
        return _SPACE
    return _STOP if c in ".,;:?'\"()-" else _SYMBOL


_KINDS = np.array([_kind(chr(i)) for i in range(_TABLE)] + [_FOREIGN], np.uint8)
_ENDS = frozenset(".,;:?!'\"()-…»«“”’")


def _shape(words: list[str]) -> tuple[float, float, float, float]:
    """Shares of words that repeat the one before, are in capitals, end in an odd sign, and are nothing but signs."""
    repeats = sum(map(str.__eq__, words, words[1:]))
    capitals = sum(len(w) > 1 and w.isupper() for w in words)
    odd = bare = 0
    for w in words:
        if not w[-1].isalnum():
            if w[-1] not in _ENDS or len(w) > 1 and w[-1] == w[-2]:
                odd += 1
            if not w[0].isalnum() and not any(map(str.isalnum, w)):
                bare += 1
    n = len(words)
    return repeats / n, capitals / n, odd / n, bare / n


def statistics(text: str) -> list[float]:
    """The numbers of a text, in the order of ``NAMES``."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.bincount(_KINDS[np.minimum(code, _TABLE)], minlength=7) / len(code)
    chars = np.bincount(np.minimum(code, _TABLE))
    p = chars[chars > 0] / len(code)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    changes = np.flatnonzero(np.fromiter(map(str.__ne__, words, words[1:]), bool, len(words) - 1))
    run = np.diff(np.r_[-1, changes, len(words) - 1]).max()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    split = [x.split() for x in lines]
    long = [w for w in split if len(w) >= LINE_WORDS] or split
    worst = np.max([_shape(w) for w in long], axis=0)
    signs = max(sum(not w[-1].isalnum() for w in ws) / len(ws) for ws in long)
    return [
        *(float(np.log1p(x)) for x in (len(code), len(words), len(lines))),
        *kinds.tolist(),
        float(-(p * np.log2(p)).sum()),
        float(p.max()),
        float(sizes.mean()),
        float(sizes.std()),
        float(np.log1p(sizes.max())),
        len(counts) / len(words),
        max(counts.values()) / len(words),
        len(pairs) / max(1, len(words) - 1),
        _shape(words)[0],
        float(np.log1p(run)),
        *_shape(words)[1:],
        float((sizes == 1).mean()),
        len(set(lines)) / len(lines),
        len(words) / len(lines),
        float(np.log1p(max(map(len, split)))),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines),
        *worst.tolist(),
        signs,
    ]


@dataclass
class Trees:
    """Trees as flat arrays over all nodes; a leaf is its own left and right. ``roots`` has each tree's first node."""

    statistic: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of statistics: one step a level for all rows and trees."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(LEVELS):
            at = np.where(x[rows, self.statistic[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def edges(x: np.ndarray) -> list[np.ndarray]:
    """Ascending thresholds of each statistic: between neighbouring values, at quantiles where there are many."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > BINS:
            values = np.unique(np.quantile(column, np.linspace(0, 1, BINS)))
        out.append((values[:-1] + values[1:]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1."""
    cuts = edges(x)
    bins = np.column_stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)])
    p = min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
    base = float(np.log(p / (1 - p)))
    nodes: dict[str, list] = {n: [] for n in ("statistic", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node() -> int:
        for n, v in (("statistic", 0), ("threshold", np.inf), ("left", len(nodes["left"])), ("right", len(nodes["right"])), ("value", 0.0)):
            nodes[n].append(v)
        return len(nodes["value"]) - 1

    raw = np.full(len(y), base)
    for _ in range(TREES if len(y) and 0 < y.sum() < len(y) else 0):
        q = 1 / (1 + np.exp(-raw))
        gradient, curvature = q - y, np.maximum(q * (1 - q), 1e-9)
        roots.append(node())
        at = np.full(len(y), roots[-1])
        level = [roots[-1]]
        for depth in range(LEVELS + 1):
            below = []
            for leaf in level:
                mine = np.flatnonzero(at == leaf)
                g, h = gradient[mine].sum(), curvature[mine].sum()
                best = _best_split(bins[mine], gradient[mine], curvature[mine], g, h) if depth < LEVELS else None
                if best is None:
                    nodes["value"][leaf] = float(-RATE * g / (h + RIDGE))
                    continue
                j, b = best
                left, right = node(), node()
                nodes["statistic"][leaf], nodes["threshold"][leaf] = j, float(cuts[j][b])
                nodes["left"][leaf], nodes["right"][leaf] = left, right
                at[mine] = np.where(bins[mine, j] <= b, left, right)
                below += [left, right]
            level = below
        raw += np.array(nodes["value"])[at]
    kinds = {"statistic": np.int64, "left": np.int64, "right": np.int64}
    return Trees(**{n: np.array(v, kinds.get(n, np.float64)) for n, v in nodes.items()}, roots=np.array(roots, np.int64), base=base)


def _best_split(bins: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, g: float, h: float) -> tuple[int, int] | None:
    """Statistic and last bin of the left side with the largest gain; None if none gains. One histogram for all statistics."""
    if len(bins) < 2 * LEAST:
        return None
    wide = bins.shape[1]
    flat = (bins + np.arange(wide) * BINS).ravel()
    size = wide * BINS
    n, gl, hl = (np.bincount(flat, None if w is None else np.repeat(w, wide), minlength=size).reshape(wide, BINS).cumsum(1) for w in (None, gradient, curvature))
    gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
    gain[(n < LEAST) | (len(bins) - n < LEAST)] = 0
    j, b = divmod(int(gain.argmax()), BINS)
    return (j, b) if gain[j, b] > 1e-6 else None


def sampled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """text and quality of at most ``most`` training rows, equal texts of one label once."""
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    train = train.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    chosen = train.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # `most` rows of two numbers
    one = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    return one.groupBy(F.xxhash64("text").alias("h"), "quality").agg(F.min("text").alias("text")).select("text", "quality")


def measured(rows: DataFrame, keep: str) -> DataFrame:
    """Column ``keep`` and ``x``, the statistics, of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, most=STEP_CHARS):
            x = [statistics(t or "") for t in step["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(step[keep], pa.int64()), pa.array(x, pa.list_(pa.float64()))], [keep, "x"])

    return rows.select(F.col(keep).cast("long"), "text").mapInArrow(run, f"{keep} long, x array<double>")


def model(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Trees:
    """Trees learnt from at most ``most`` labelled rows."""
    got = written(measured(sampled(docs, labels, most), "quality"), "statistics").orderBy("quality", "x").collect()
    return fit(np.array([r.x for r in got]).reshape(len(got), len(NAMES)), np.array([r.quality for r in got], float))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good likelier), predicted (1 if score >= ``threshold``) of every row."""
    trees = model(docs, labels, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            score = trees.score(np.array([statistics(t or "") for t in step["text"]]))
            yield pa.RecordBatch.from_arrays([pa.array(step["doc_id"], pa.int64()), pa.array(score)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
