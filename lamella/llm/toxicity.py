"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, compatibility forms, letters of other
scripts that look Latin, digits and signs that stand for letters, and letters
set apart by dots or dashes. The lexicon (words and word beginnings, with
weights) and phrases that excuse a term are learned from labelled documents,
of near copies from one: else chance words of a copied text would weigh. A
term counts by its presence or, if clean texts hold it now and then, by its
repetition.
The summed weights, also relative to the text's length, give the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder, small_batches, stored

#: Labelled documents learned from, at most so many of each class.
SAMPLE = 20_000
PREFIXES = range(4, 8)
EVIDENCE = 30.0
LEAST_ODDS = 25
MAX_WEIGHT = 6.0
#: Terms and excused phrases of a lexicon at most, of the largest weights and counts: what the driver collects.
MAX_TERMS, MAX_PHRASES = 50_000, 10_000
#: Phrases in which a term that is often an insult is none, beside those learned.
EXCUSED = ("clown fish", "circus clown", "trash can", "trash bag", "trash bin", "pond scum", "sore loser rule")

LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁһԛѡӏкмтвнгαβεικνορτυχγηω",
        "aeopcyxijsdhqwlkmtbhraбeiknoptuxyhw".replace("б", "b"),
    )
)
SIGNS = str.maketrans("01345789@$!|€", "oieastbgasilE".lower())
_look = re.compile("[" + "".join(LOOKALIKES) + "]")
#: Whole runs only: a run without a letter behind it is not looked at again from within.
_signs = re.compile(r"(?<![01345789@$!|€])[01345789@$!|€]++(?=[^\W\d_])")
_apart = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-_*·]){2,}[^\W\d_](?![^\W_])")
_between = re.compile(r"[.\-_*·]")
_other = re.compile(r"[\W\d_]+")
_plain = re.compile(r"[ -~\n]*")


def fold(text: str | None) -> str:
    """The letters of a text as words between single blanks, with one at each end."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower()
        text = _look.sub(lambda m: LOOKALIKES[m[0]], text)
    text = _signs.sub(lambda m: m[0].translate(SIGNS), text)
    text = _apart.sub(lambda m: _between.sub("", m[0]), text)
    return f" {_other.sub(' ', text).strip()} "


def terms(folded: str) -> Counter:
    """How often words, as ' word ', and their beginnings, as ' begin', stand in a text."""
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        out[f" {w} "] += n
        for k in PREFIXES:
            if len(w) > k:
                out[f" {w[:k]}"] += n
    return out


def copy_keys(folded: str) -> tuple[int, int]:
    """Two keys that near copies share with high probability: smallest hashes of five-word shingles."""
    words = folded.split()
    starts = range(max(1, len(words) - 4))
    return tuple(min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5]), seed) for i in starts) >> 1 for seed in (1, 2))


class Lexicon:
    """weights by term, excused phrases, and the coefficients of the score."""

    def __init__(self, weights: dict[str, float], excused: set[str], scale: np.ndarray):
        self.weights, self.excused, self.scale = weights, excused, scale
        self._machine = None

    def __getstate__(self):
        return self.weights, self.excused, self.scale

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def machine(self):
        if self._machine is None:
            m = ahocorasick.Automaton()
            for t, w in self.weights.items():
                m.add_word(t, (len(t), w))
            for p in self.excused:
                m.add_word(f" {p} ", (len(p) + 2, -1.0))
            m.make_automaton()
            self._machine = m
        return self._machine

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Sum of weights (the largest for each word), and that over the root and the number of words."""
        folded = fold(text)
        words = max(1, folded.count(" ") - 1)
        best: dict[int, float] = {}
        off = []
        if self.weights:
            for end, (n, w) in self.machine.iter(folded):
                start = end - n + 1
                if w < 0:
                    off.append((start, end))
                else:
                    best[start] = max(w, best.get(start, 0.0))
        covered = np.zeros(len(folded) + 1 if off else 0, np.int32)
        for a, b in off:
            covered[a] += 1
            covered[b] -= 1
        covered = np.cumsum(covered)
        total = sum(w for s, w in best.items() if not (off and covered[s]))
        return total, total / math.sqrt(words), 100 * total / words

    def score(self, text: str | None) -> float:
        return _squash(float(self.scale[0] + np.dot(self.scale[1:], self.features(text))))


def _squash(z: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def log_odds(a: Column, b: Column, n_bad: int, n_good: int) -> Column:
    """Log odds of a of n_bad against b of n_good; 0 unless they are high and beyond chance (likelihood ratio)."""
    odds = F.log((a + 0.5) / (n_bad + 1)) - F.log((b + 0.5) / (n_good + 1))
    p = (a + b) / (n_bad + n_good)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (p * n))).otherwise(0.0)
    ratio = 2 * (part(a, n_bad) + part(b, n_good))
    return F.when((a >= 3) & (odds > math.log(LEAST_ODDS)) & (ratio > EVIDENCE), odds).otherwise(0.0)


def choose(counts: DataFrame, n_bad: int, n_good: int, most: int = MAX_TERMS) -> dict[str, float]:
    """Weights of the terms that mark toxic documents, `most` of them. counts: (term, bad1, bad2, good1, good2),
    the toxic and the clean documents with a term once or more, and twice or more."""
    once, twice = (log_odds(F.col(f"bad{k}"), F.col(f"good{k}"), n_bad, n_good) for k in (1, 2))
    weighed = counts.select("term", F.least(F.lit(MAX_WEIGHT), F.greatest(once, twice / 2)).alias("w")).where("w > 0")
    out = {r.term: r.w for r in weighed.orderBy(F.desc("w"), "term").limit(most).collect()}
    # A term says no more than a shorter beginning of it that weighs as much.
    return {t: w for t, w in out.items() if not any(out.get(t[: n + 1], 0) >= w for n in PREFIXES if n + 1 < len(t.rstrip()))}


def fit_scale(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps; no class weighs more than the other."""
    if len(set(y.tolist())) < 2:
        return np.array([50.0 if len(y) and y[0] else -3.0, 0, 0, 0])
    a = np.c_[np.ones(len(x)), x]
    size = np.maximum(a.std(axis=0), 1e-9)
    size[0] = 1
    a = a / size
    w = np.zeros(a.shape[1])
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ridge = np.diag([1e-6, *[1e-3] * x.shape[1]]) * len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (balance * (y - p)) - ridge @ w
        h = a.T @ (a * (balance * np.maximum(p * (1 - p), 1e-6))[:, None]) + ridge
        step = np.linalg.solve(h, g)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w / size


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """Learns from the labelled documents given, `sample` of each class at most
    (those with the smallest hashes of doc_id). Null labels, ids and texts are
    passed over; a document labelled more than once is toxic if one label says
    so. Without labels of both classes no text is toxic (or all are).
    """
    small_batches(docs.sparkSession)
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for label in (0, 1):
        if n := counts.get(label):
            part = min(1.0, sample / n)
            at = (1 << 63) - 1 if part == 1 else int((2 * part - 1) * 2**63)
            chosen = chosen | ((F.col("toxic") == label) & (F.col("h") <= F.lit(at)))
    picked = F.broadcast(marks.where(chosen).select("doc_id", "toxic"))  # about 2 * sample rows of two numbers

    def keys(batches):
        for batch in batches:
            k = [copy_keys(fold(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x[i] for x in k], pa.int64()) for i in (0, 1)]], names=["toxic", "text", "k1", "k2"])

    labelled = docs.where("text IS NOT NULL").select("doc_id", "text").join(picked, "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")
    known = stored(labelled.mapInArrow(keys, "toxic int, text string, k1 long, k2 long").dropDuplicates(["toxic", "k1"]).dropDuplicates(["toxic", "k2"]).select("toxic", "text"))
    n_rows = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_good, n_bad = n_rows.get(0, 0), n_rows.get(1, 0)

    def count_terms(batches):
        counts = [Counter() for _ in range(4)]
        for batch in batches:
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms(fold(x.as_py()))
                counts[0 if label else 2].update(found.keys())
                counts[1 if label else 3].update(t for t, n in found.items() if n > 1)
            if sum(map(len, counts)) > 200_000:
                yield told(counts)
        yield told(counts)

    def told(counts: list[Counter]) -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[2].keys())
        out = [pa.array(names, pa.string()), *[pa.array([c[t] for t in names], pa.int64()) for c in counts]]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(out, names=["term", "bad1", "bad2", "good1", "good2"])

    counted = known.mapInArrow(count_terms, "term string, bad1 long, bad2 long, good1 long, good2 long")
    counted = counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("bad1", "bad2", "good1", "good2")]).where("bad1 >= 3")
    weights = choose(counted, n_bad, n_good) if n_bad else {}
    draft = Lexicon(weights, set(), np.zeros(4))

    def phrases(batches):
        found: Counter = Counter()
        for batch in batches:
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                folded = fold(x.as_py())
                for end, (n, _) in draft.machine.iter(folded) if weights else ():
                    a = end - n + 1
                    b = folded.index(" ", a + 1)
                    word = folded[a + 1 : b]
                    found.update((label, p) for p in {f"{word} {folded[b + 1 : max(folded.find(' ', b + 1), b + 1)]}", f"{folded[folded.rfind(' ', 0, a) + 1 : a]} {word}"} if not p.startswith(" ") and not p.endswith(" "))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["toxic", "phrase", "n"])

    seen = known.mapInArrow(phrases, "toxic int, phrase string, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("bad"))
    excused = {r["phrase"] for r in seen.where("good >= 5 AND bad IS NULL").orderBy(F.desc("good"), "phrase").limit(MAX_PHRASES).collect()} | set(EXCUSED)
    draft = Lexicon(weights, excused, np.zeros(4))

    def measure(batches):
        for batch in batches:
            x = np.array([draft.features(t.as_py()) for t in batch.column(1)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, i].copy()) for i in range(3)]], names=["toxic", "a", "b", "c"])

    got = known.select(F.col("toxic").cast("int"), "text").mapInArrow(measure, "toxic int, a double, b double, c double").toPandas()
    scale = fit_scale(got[["a", "b", "c"]].to_numpy(), got["toxic"].to_numpy().astype(float))
    return Lexicon(weights, excused, scale)


def rate(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """-> (doc_id, score, predicted), a row for each row of docs; whole texts are read.

    Null and empty texts have the score of a text without a term.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def scan(batches):
        lexicon = shared.value
        for batch in batches:
            s = np.array([lexicon.score(x.as_py()) for x in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, score double, predicted int")


def held_out(doc_id):
    return F.coalesce(fold_remainder(doc_id, 5) == 0, F.lit(False))
