"""Toxicity scores of whole texts: a learned lexicon, misspellings, and the context of each hit.

1. Lexicon. A bounded sample of labelled training rows (``MOST_LABELLED``) says which words, and which word beginnings,
   stand in toxic texts far more often than elsewhere; equal texts count once. Counts are summed per task before they are
   shuffled. All terms that pass are kept: the sample bounds how many there can be.
2. Matching. The lexicon is a trie; a Levenshtein automaton for one edit runs along it. Their intersection is built state by
   state as words ask for it, so a word costs one table step a letter and most words die early. Whole words of
   ``LEAST_FUZZY`` letters or more match with up to one edit and common letter look-alikes; shorter ones, of which one edit
   makes too many other words, and beginnings match exactly.
3. Context. A hit inside a pair of quotation marks (an apostrophe inside a word is none), in a clause that a word of
   reporting opens ("she said", "she wrote:"), or named as a word ("the word idiot") is quoted. For all other hits the sample
   says which words within ``WINDOW`` words before or after them go with texts that are not toxic, or with toxic ones, beyond
   chance; the sum of their log odds says how much of the hit is abuse. It is the more so with an address to a person near
   it. Hits are summed apart by kind.
4. Score. A logistic model over these sums, fitted on the same bounded sample, gives a number from 0 to 1 for every row.

Labels are read only for rows whose crc32(doc_id as text) mod 4 is not 2. Labels, language, source and doc_id are never
inputs of a score. Null text counts as empty and gets the score of a text without hits. Repeated rows are scored each; of
several texts of one doc_id learning takes the one that sorts first. Extra columns are ignored. An empty table gives no rows.
Without any usable labels (none, or one class) scores come from SEED_TERMS alone. If a doc_id has several labels the largest
holds.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, written

#: Labelled training rows that learning uses at most (rows are taken in the order of a hash of doc_id). Rates of terms and
#: the model's eight weights do not get better from more.
MOST_LABELLED = 20_000
#: In how many toxic texts of the sample a term must stand.
LEAST_TOXIC = 4
#: Letters of the shortest whole word that matches with an edit.
LEAST_FUZZY = 5
#: Lower bound of the toxic share among rows with the term (Wilson interval, z = 2).
LEAST_SHARE = 0.5
WINDOW = 8
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6)
#: Words before a hit, in its sentence, that a word of reporting may stand; and that a word for a word may stand.
REPORTED, NAMED = 4, 2
#: Standard errors by which a word's share of toxic texts must differ from that of all hits to be a sign of context.
SURE = 4
#: Seed terms, words of reporting, words for a word and what stands before these, address words, look-alikes.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting")
REPORTING = frozenset("said says wrote writes called calls quoted quotes quote sagte schrieb nannte dijo llamó escribió dit écrit appelé".split())
NAMES = frozenset("word words term slur insult wort begriff beleidigung palabra término insulto mot terme insulte".split())
ARTICLES = frozenset("the a an this that der die das den dem ein eine einem el la un una esta ese le une ce cette l".split())
ADDRESS = frozenset("you your yours du dich dein ihr tu te toi tú usted vous ton votre".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_WORD = re.compile(r"[^\W_]+(?:[@$!][^\W_]+)*")
# a quotation may be of any length and ends with its paragraph
_QUOTED = re.compile(
    "|".join(
        [r'"[^"\n]++"', r"“[^“”\n]++”", r"„[^„“”\n]++[“”]", r"«[^«»\n]++»"]
        + [r"(?<!\w)[‘'](?=\S)(?:[^‘’'\n]|(?<=\w)[’'](?=\w))++(?<=\S)[’'](?!\w)"]
    )
)
_STOP, _PAUSE = re.compile(r"[.!?;:\n]"), re.compile(r"[.!?;:,\n]")
FEATURES = 8


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


class Matcher:
    """Trie of terms, intersected with Levenshtein automata for ``edits`` edits, made deterministic on demand.

    A state is the set of (trie node, edits so far) that a prefix of a word can stand at; ``*`` at the end of a term
    accepts any continuation and allows no edit.
    """

    def __init__(self, terms: Iterable[str], edits: int = 1, least: int = LEAST_FUZZY):
        self.edits, self.children, self.exact, self.ends, self.opens = edits, [{}], [True], {}, {}
        for fuzzy in (False, True):
            for term in terms:
                word, opened = term.rstrip("*"), term.endswith("*")
                if fuzzy and (opened or len(word) < least):
                    continue
                node = 0 if not fuzzy else self._child(0, "\0", True)
                for c in word:
                    node = self._child(node, c, fuzzy)
                (self.opens if opened else self.ends).setdefault(node, term)
        start = {(0, 0)}
        if "\0" in self.children[0]:
            start.add((self.children[0]["\0"], 0))
        self.states: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.final: list[tuple[str, int] | None] = []
        self.start = self._state(start)
        self.memo: dict[str, tuple[str, int] | None] = {}

    def _child(self, node: int, c: str, fuzzy: bool) -> int:
        if c not in self.children[node]:
            self.children[node][c] = len(self.children)
            self.children.append({})
            self.exact.append(not fuzzy)
        return self.children[node][c]

    def _state(self, at: set[tuple[int, int]]) -> int:
        """The state of a set, closed under skipping a letter of the term (one edit)."""
        todo = list(at)
        while todo:
            node, e = todo.pop()
            if e < self.edits and not self.exact[node]:
                for c, nxt in self.children[node].items():
                    if c != "\0" and (nxt, e + 1) not in at:
                        at.add((nxt, e + 1))
                        todo.append((nxt, e + 1))
        key = frozenset(at)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.ends[n]) for n, e in key if n in self.ends]
            opens = [self.opens[n] for n, _ in key if n in self.opens]
            self.final.append((min(ends)[1], min(ends)[0]) if ends else None)
            self.accepts.append((min(opens), 0) if opens else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        at: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            nxt = self.children[node].get(c)
            if nxt is not None:
                at.add((nxt, e))
            if e < self.edits and not self.exact[node]:
                at.add((node, e + 1))  # a letter too many
                at |= {(n, e + 1) for x, n in self.children[node].items() if x != c}
        got = self.steps[state][c] = self._state(at) if at else -1
        return got

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a word stands for, and how many edits it is away."""
        state, steps = self.start, self.steps
        opened = None
        for c in word:
            nxt = steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return opened
            opened = opened or self.accepts[state]
        return self.final[state] if self.final[state] and (not opened or not self.final[state][1]) else opened


class Lexicon:
    """Weighted terms and their matcher; one for each Python worker and lexicon. A key that begins with ``<`` or ``>`` is
    no term but a word before or after a hit, with its log odds."""

    def __init__(self, weights: dict[str, float]):
        self.signs = {k: w for k, w in weights.items() if k[0] in "<>"}
        self.weights = {k: w for k, w in weights.items() if k[0] not in "<>"}
        self.matcher, self.known = Matcher(self.weights), {}

    def hits(self, words: Iterable[str]) -> dict[str, tuple[str, int]]:
        """Which of the words stand for terms. Words that came before are remembered in bounded space."""
        known, got = self.known, {}
        if len(known) > 300_000:
            known.clear()
        for w in words:
            if w in known:
                hit = known[w]
            else:
                hit = self.matcher.match(w)
                if hit is None and not w.isalpha():
                    hit = self.matcher.match(w.translate(LOOKALIKE))
                known[w] = hit
            if hit:
                got[w] = hit
        return got


def _reported(text: str, words: list[str], spans: list[tuple[int, int]], i: int) -> bool:
    """Whether word ``i`` is what somebody said or a word that is spoken about, by the clause that stands before it."""
    for j in range(max(1, i - NAMED), i):
        if words[j] in NAMES and words[j - 1] in ARTICLES and not _PAUSE.search(text, spans[j - 1][1], spans[i][0]):
            return True
    for j in range(max(0, i - REPORTED), i):
        if words[j] in REPORTING:
            # a colon right after it opens what was said
            begin = spans[j][1] + (text[spans[j][1] : spans[j][1] + 1] == ":")
            if not _STOP.search(text, begin, spans[i][0]):
                return True
    return False


def _found(text: str, lexicon: Lexicon) -> Iterator[tuple[int, list[str], bool]]:
    """Of each hit: its place, the words of the text, and whether it is quoted. ``text`` is in lower case."""
    words = _WORD.findall(text)
    hits = lexicon.hits(set(words))
    if not hits:
        return
    spans = [m.span() for m in _WORD.finditer(text)]
    quotes = [m.span() for m in _QUOTED.finditer(text)]
    begins = [a for a, _ in quotes]
    for i, w in enumerate(words):
        if w in hits:
            at = bisect_right(begins, spans[i][0]) - 1
            yield i, words, at >= 0 and quotes[at][1] >= spans[i][1] or _reported(text, words, spans, i)


def _around(words: list[str], i: int) -> set[str]:
    """The words before and after word ``i`` as keys of signs."""
    return {f"<{x}" for x in words[max(0, i - WINDOW) : i]} | {f">{x}" for x in words[i + 1 : i + WINDOW + 1]}


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Sums over the hits of a text; see the order in the code. All are 0 for a text without hits."""
    exact = fuzzy = quoted = abusive = weight = 0.0
    terms, n, words = set(), 0, []
    for i, words, in_quotes in _found(text.lower(), lexicon):
        term, edits = lexicon.known[words[i]]
        n += 1
        terms.add(term)
        if in_quotes:
            quoted += 1
            continue
        sign = sum(lexicon.signs.get(x, 0.0) for x in sorted(_around(words, i))) if lexicon.signs else 0.0
        part = float(np.exp(min(0.0, sign)))  # how much of the hit is abuse; the rest is quoted
        quoted += 1 - part
        weight += part * lexicon.weights[term]
        exact += part * (not edits)
        fuzzy += part * bool(edits)
        abusive += part * (not ADDRESS.isdisjoint(words[max(0, i - WINDOW) : i + WINDOW + 1]))
    if not n:
        return [0.0] * FEATURES
    return [float(np.log1p(exact)), float(np.log1p(fuzzy)), float(np.log1p(quoted)), float(np.log1p(abusive)), float(np.log1p(weight)), float(np.log1p(len(terms))), n / max(20, len(words)) * 20, min(1.0, exact + fuzzy)]


def _sampled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id and toxic of at most ``most`` training rows."""
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return train.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """term -> weight from rows of text and toxic. A term is a word, or a word's beginning with ``*`` after it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches):
            every, toxic = Counter(), Counter()
            rows = toxic_rows = 0
            for text, label in zip(step["text"], step["toxic"], strict=True):
                words = {w for w in _WORD.findall((text or "").lower()) if len(w) > 1}
                terms = words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) >= n}
                every.update(terms)
                rows += 1
                if label:
                    toxic.update(terms)
                    toxic_rows += 1
            every[""], toxic[""] = rows, toxic_rows
            names = list(every)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([every[t] for t in names], pa.int64()), pa.array([toxic[t] for t in names], pa.int64())], ["term", "n", "toxic"])

    # copies of a text would make terms of all its words
    once = sample.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    counts = once.mapInArrow(count, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    p = F.col("toxic") / F.col("n")
    n = F.col("n")
    low = (p + 2 / n - 2 * F.sqrt(p * (1 - p) / n + 1 / (n * n))) / (1 + 4 / n)
    # the row of all texts stays whatever its share is; it sorts first
    good = counts.withColumn("low", low).where((F.col("term") == "") | ((F.col("toxic") >= LEAST_TOXIC) & (F.col("low") >= LEAST_SHARE)))
    got = good.orderBy(F.col("term") != "", F.desc("low"), F.desc("toxic"), F.length("term"), "term").collect()  # bounded by the sample
    if not got or not 0 < got[0]["toxic"] < got[0]["n"]:
        return dict.fromkeys(SEED_TERMS, 1.0)
    base = np.log(got[0]["toxic"] / (got[0]["n"] - got[0]["toxic"]))
    # toxic texts of each beginning that one word of it accounts for
    alone = {(r["term"][:k], r["toxic"]) for r in got[1:] if not r["term"].endswith("*") for k in BEGINNINGS}
    weights: dict[str, float] = {}
    for row in got[1:]:
        term, word = row["term"], row["term"].rstrip("*")
        covered = any(f"{word[:k]}*" in weights for k in BEGINNINGS if k <= len(word))
        # a beginning counts only where it unites several words; a word that a beginning covers stays where it can be misspelt
        if term.endswith("*") and (covered or (word, row["toxic"]) in alone) or covered and len(word) < LEAST_FUZZY:
            continue
        weights[term] = float(np.log((row["toxic"] + 0.5) / (row["n"] - row["toxic"] + 0.5)) - base)
    return weights or dict.fromkeys(SEED_TERMS, 1.0)


def learn_signs(sample: DataFrame, terms: dict[str, float]) -> dict[str, float]:
    """``<word`` or ``>word`` -> log odds of words before or after hits that are not quoted, from rows of text and toxic: of
    those whose share of toxic texts lies beyond chance (SURE) off the share of all texts with such a hit. Sums of toxic
    signs do not make more than a whole hit of one, they only outweigh the others."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for step in steps(batches):
            every, toxic = Counter(), Counter()
            for text, label in zip(step["text"], step["toxic"], strict=True):
                near = [_around(words, i) for i, words, in_quotes in _found((text or "").lower(), lexicon) if not in_quotes]
                if near:
                    signs = {"", *set().union(*near)}
                    every.update(signs)
                    toxic.update(signs if label else ())
            names = list(every)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([every[t] for t in names], pa.int64()), pa.array([toxic[t] for t in names], pa.int64())], ["sign", "n", "toxic"])

    once = sample.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic")
    counts = once.mapInArrow(count, "sign string, n long, toxic long").groupBy("sign").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    counts = written(counts.where(f"n >= {LEAST_TOXIC} or sign = ''"), "signs")
    whole = counts.where("sign = ''").first()
    if whole is None or not 0 < whole["toxic"] < whole["n"]:
        return {}
    base = whole["toxic"] / whole["n"]
    n, p, z = F.col("n"), F.col("toxic") / F.col("n"), float(SURE)
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (middle - width) / (1 + z * z / n), (middle + width) / (1 + z * z / n)
    sure = counts.where("sign <> ''").where((low > base) | (high < base))
    odds = F.log((F.col("toxic") + 0.5) / (n - F.col("toxic") + 0.5)) - float(np.log(base / (1 - base)))
    return {r["sign"]: r["odds"] for r in sure.select("sign", odds.alias("odds")).orderBy("sign").collect()}  # bounded by the sample


_lexicons: dict[tuple, Lexicon] = {}


def featured(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id and features (array<double>) of every row."""
    key = tuple(sorted(weights.items()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _lexicons:
            _lexicons.clear()
            _lexicons[key] = Lexicon(dict(key))
        for step in steps(batches):
            got = [features(t or "", _lexicons[key]) for t in step["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(step["doc_id"], pa.int64()), pa.array(got, pa.list_(pa.float64()))], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, features array<double>")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (intercept last) of a logistic model, by Newton steps with a ridge penalty."""
    z = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def model(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights of the score, from at most ``most`` labelled rows."""
    chosen = F.broadcast(_sampled(docs, labels, most))  # `most` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    sample = written(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")
    terms = learn_terms(sample)
    terms |= learn_signs(sample, terms)
    got = featured(sample, terms).join(F.broadcast(sample.select("doc_id", "toxic")), "doc_id").select("features", "toxic").collect()
    y = np.array([r["toxic"] for r in got], float)
    if not got or not 0 < y.sum() < len(y):
        return terms, np.array([0, 0, 0, 0, 0, 0, 0, 5.0, -4.0])
    return terms, fit(np.array([r["features"] for r in got]), y)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 if score >= ``threshold``) of every row."""
    terms, w = model(docs, labels, most)
    sums = sum((F.get("features", F.lit(i)) * float(v) for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
    rows = featured(docs, terms).select("doc_id", (1 / (1 + F.exp(-sums))).alias("score"))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose text is not predicted toxic, with all columns; texts pass through once and are not shuffled."""
    terms, w = model(docs, labels)
    key, kinds = tuple(sorted(terms.items())), docs.schema
    weights = w.copy()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _lexicons:
            _lexicons.clear()
            _lexicons[key] = Lexicon(dict(key))
        for batch in batches:
            keep = []
            for text in batch.column("text"):
                x = features(text.as_py() or "", _lexicons[key])
                keep.append(1 / (1 + np.exp(-(np.dot(x, weights[:-1]) + weights[-1]))) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, kinds)
