"""Toxic passages as maximum-scoring segments of token log-odds.

A token's evidence is that of the features it has: the word and its character n-grams with
marks for both ends. Log-odds of features between toxic and clean documents are smoothed by
a Dirichlet prior in proportion to the mean of their shares in both, so that they do not depend
on how many documents are toxic, and only those that stand clear of their own standard error
count. A text is then a sequence of scores, positive at
such tokens and slightly negative elsewhere; one linear scan finds all maximal segments.
Their sums are turned into expected numbers of chance segments by extreme-value theory,
and the evidence of all significant segments into a probability by a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.llm.common import map_texts, slices, texts_of

#: About so many labelled documents at most are fitted on, chosen by a hash of their text.
FIT_ROWS = 20_000
#: Features of a word: itself and its n-grams of this length, with ``<`` and ``>`` at the ends.
GRAM = 5
#: A feature counts with so many toxic documents, this log-odds and this many standard errors.
LEAST_DOCS, LEAST_ODDS, LEAST_Z = 4, 3.6, 2.0
#: Strength of the prior as a share of each label's documents, and the score of a token without a
#: counting feature.
PRIOR, DRIFT = 0.04, -0.3
#: Features kept, by standard errors: the lexicon that travels to the tasks is bounded.
LEXICON = 20_000
#: A segment counts if fewer than this many of its sum are expected by chance in its text.
SIGNIFICANT = 0.05

_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class ToxicityModel:
    """Scores of features, the extreme-value rate and the logistic curve."""

    scores: dict[str, float]
    rate: float
    scale: float
    intercept: float
    slope: float


def marked(text: str) -> str:
    """Lower-case words between ``<`` and ``>``, nothing else."""
    words = _NOT_LETTERS.sub("><", text.lower())
    return f"<{words}>"


def features(text: str) -> set[str]:
    """The distinct features of a text."""
    found: set[str] = set()
    for word in set(marked(text)[1:-1].split("><")):
        if word:
            word = f"<{word}>"
            found.add(word)
            found.update(word[i : i + GRAM] for i in range(len(word) - GRAM + 1))
    return found


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments ``(sum, first, last)``: Ruzzo and Tompa's linear scan.

    ``scores`` are the positive tokens ``(place, score)`` in order; every token between
    two of them has the score ``drift``.
    """
    kept: list[list[float]] = []  # left sum, right sum, first, last
    total, place = 0.0, -1
    for at, score in scores:
        total += drift * (at - place - 1)
        now = [total, total + score, at, at]
        total, place = now[1], at
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][0] >= now[0]:
                k -= 1
            if k < 0 or kept[k][1] >= now[1]:
                kept.append(now)
                break
            now = [kept[k][0], now[1], kept[k][2], at]
            del kept[k:]
    return [(r - l, int(a), int(b)) for l, r, a, b in kept]


class Scanner:
    """Reads the positive tokens of a text in one Aho-Corasick pass over its features."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for feature, score in model.scores.items():
            self.automaton.add_word(feature, (score, len(feature)))
        if model.scores:
            self.automaton.make_automaton()

    def tokens(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """The number of tokens, and place and score of those with a counting feature."""
        words = marked(text)
        n = words.count("<") - words.count("<>")
        best: dict[int, float] = {}
        if self.model.scores:
            ends: list[tuple[int, float]] = []
            for end, (score, length) in self.automaton.iter(words):
                ends.append((end - length + 1, score))
            if ends:
                # a token's place is the number of words that end before it starts
                ends.sort()
                at = place = 0
                for start, score in ends:
                    place += words.count(">", at, start)
                    at = start
                    best[place] = max(score, best.get(place, 0.0))
        return n, sorted(best.items())

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The summed evidence of a text and its significant segments ``(first, last, sum)``.

        A segment of sum S is expected ``scale * n * exp(-rate * S)`` times by chance; its
        evidence is the negative logarithm of that.
        """
        n, scores = self.tokens(text)
        total, found = 0.0, []
        for s, first, last in segments(scores, DRIFT):
            surprise = self.model.rate * s - math.log(max(self.model.scale * n, 1e-300))
            if surprise > -math.log(SIGNIFICANT):
                total += surprise
                found.append((first, last, s))
        return total, found


def _probability(model: ToxicityModel, evidence: float) -> float:
    x = model.intercept + model.slope * math.log1p(evidence)
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, x))))


def _chosen(labelled: DataFrame) -> DataFrame:
    """About ``FIT_ROWS`` rows, the same ones every time, by a hash of the text; copies once."""
    n = labelled.count()
    share = min(1.0, FIT_ROWS / max(1, n))
    hashed = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    chosen = labelled.where(hashed < int(share * 1_000_000)) if share < 1 else labelled
    return chosen.dropDuplicates()


def fit_toxicity(labelled: DataFrame) -> ToxicityModel:
    """Fits a model on ``(text, toxic)`` rows; rows with a NULL label are left out.

    At most about ``FIT_ROWS`` rows are used, the documented bound of the fit. Counts are
    made in the tasks and added by Spark; only features that count come to the driver.
    Without rows of both labels nothing is toxic: no features, a flat curve.
    """
    labelled = _chosen(labelled.where("toxic IS NOT NULL").select("text", F.col("toxic").cast("int").alias("toxic")))

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream):
            sums: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                sums[toxic].update(features(text))
                sums[toxic][""] += 1
            keys = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys)] + [pa.array([sums[k][f] for f in keys], pa.int64()) for k in (1, 0)],
                names=["feature", "toxic", "clean"],
            )

    counts = labelled.mapInArrow(count, "feature string, toxic bigint, clean bigint")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.where((F.col("toxic") >= LEAST_DOCS) | (F.col("feature") == ""))
    # the two totals decide what counts; both are in the row without a feature
    totals = counts.where("feature = ''").select(F.col("toxic").alias("t"), F.col("clean").alias("c"))
    mean = (F.col("toxic") / F.col("t") + F.col("clean") / F.col("c")) / 2

    def smoothed(seen: str, of: str) -> Column:
        return F.col(seen) + PRIOR * F.col(of) * mean

    # shares, not odds: a word that nearly all documents have says nothing
    odds_t, odds_c = (F.log(smoothed(*x) / F.col(x[1])) for x in (("toxic", "t"), ("clean", "c")))
    error = F.sqrt(1 / smoothed("toxic", "t") + 1 / smoothed("clean", "c"))
    lexicon = (
        counts.where("feature != ''")
        .crossJoin(F.broadcast(totals.where("t > 0 AND c > 0")))
        .select("feature", (odds_t - odds_c).alias("odds"), ((odds_t - odds_c) / error).alias("z"))
        .where((F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z))
        .orderBy(F.desc("z"), "feature")
        .limit(LEXICON)
    )
    scores = {f: float(odds) for f, odds, _ in lexicon.collect()}
    raw = ToxicityModel(scores, 1.0, 1.0, 0.0, 0.0)

    def tally(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(raw)
        for batch in slices(stream):
            sums: Counter = Counter()
            for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                n, found = scanner.tokens(text)
                if not toxic:
                    sums[None] += n
                    sums.update(round(s, 1) for _, s in found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.float64()), pa.array(list(sums.values()), pa.int64())],
                names=["score", "n"],
            )

    seen = labelled.mapInArrow(tally, "score double, n bigint").groupBy("score").agg(F.sum("n").alias("n")).collect()
    rate, scale = chance_rate({s: n for s, n in seen if s is not None}, sum(n for s, n in seen if s is None), scores)
    raw = ToxicityModel(scores, rate, scale, 0.0, 0.0)

    def weigh(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(raw)
        for batch in slices(stream):
            sums = Counter(
                (round(math.log1p(scanner.evidence(text)[0]), 2), toxic)
                for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x for x, _ in sums], pa.float64()),
                    pa.array([y for _, y in sums], pa.int32()),
                    pa.array(list(sums.values()), pa.int64()),
                ],
                names=["x", "y", "n"],
            )

    binned = labelled.mapInArrow(weigh, "x double, y int, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n"))
    intercept, slope = logistic(np.array(binned.collect(), dtype=float).reshape(-1, 3))
    return ToxicityModel(scores, rate, scale, intercept, slope)


def chance_rate(counts: dict[float, int], tokens: int, scores: dict[str, float]) -> tuple[float, float]:
    """Rate and scale of the extreme-value law of segment sums in clean text.

    The rate is the positive root of the mean of ``exp(rate * score)`` being 1 over the
    tokens of clean documents, the scale their share of positive tokens. One token of each
    score is added, so that scores never seen in clean text have a chance too.
    """
    pairs = Counter(counts)
    pairs.update({round(s, 1): 1 for s in scores.values()})
    if not pairs:
        return 1.0, 1.0
    total = max(tokens, 1) + sum(pairs.values())
    values = np.array(list(pairs))
    share = np.array(list(pairs.values())) / total
    low, high = 0.0, 1.0
    mean = lambda r: float((share * np.exp(np.minimum(r * values, 700))).sum() + (1 - share.sum()) * math.exp(r * DRIFT))
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return max(high, 1e-3), float(share.sum())


def logistic(rows: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method on ``(x, y, n)``, with a weak pull to zero slope."""
    if not len(rows):
        return -4.0, 0.0
    x, y, n = rows.T
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.05 * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, score, passages array<struct<first, last, sum>>)``, one row per input row.

    ``score`` is the probability of being toxic, ``passages`` the significant segments by
    token positions, both ends inclusive. NULL and empty texts have no passages and the
    score of a text without evidence. Repeated rows stay; other columns are not read.
    """

    def setup():
        scanner = Scanner(model)

        def judge(texts: list[str]) -> dict[str, list]:
            found = [scanner.evidence(t) for t in texts]
            return {
                "score": [_probability(model, e) for e, _ in found],
                "passages": [[dict(zip(("first", "last", "sum"), s)) for s in f] for _, f in found],
            }

        return judge

    rest = "score double, passages array<struct<first bigint, last bigint, sum double>>"
    return map_texts(docs, id_col, text_col, rest, setup)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from fitting: CRC-32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
