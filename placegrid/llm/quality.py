"""Document quality by a regularised quadratic discriminant over transformed statistics of a text.

Training sees a bounded sample of labelled rows. Each class has a Gaussian whose covariance is shrunk towards that of
both classes and towards a multiple of the identity. The Cholesky factors are found once; a score comes from the
difference of the two log densities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placegrid.llm.common import GAPS, batches_of, chosen_rows, id_remainder, text_arrays, word_bounds, word_hashes

#: Most labelled rows that training may see, half of them of each label where there are as many.
TRAIN_ROWS = 4_000
THRESHOLD = 0.7

_BREAKS = np.array([b == 10 for b in range(256)])
_KINDS = np.stack([
    np.array([chr(b).isupper() and b < 128 for b in range(256)]),
    np.array([chr(b).islower() and b < 128 for b in range(256)]),
    np.array([b >= 128 for b in range(256)]),
    np.array([48 <= b <= 57 for b in range(256)]),
    np.array([chr(b) in ".,;:?'\"()-" for b in range(256)]),
    np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-" for b in range(256)]),
    np.array([chr(b) in GAPS for b in range(256)]),
]).astype(np.float64)


def _odds(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def _sums(owner: np.ndarray, amounts, many: int) -> np.ndarray:
    return np.bincount(owner, weights=amounts, minlength=many).astype(np.float64)


def _repeats(owner: np.ndarray, hashes: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pieces of every text, and pieces that equal the one before."""
    order = np.lexsort((hashes, owner))
    first = np.ones(len(order), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    again = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    return _sums(owner[order][first], None, many), _sums(owner[1:][again], None, many)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text: log sizes, and log odds of shares with a half added to each count.

    Shares of capitals, of bytes beyond ASCII, digits, punctuation, other marks and gaps among bytes; of words with a mark at
    either end, words of capitals, words without a letter, words that equal the one before and distinct words among
    words; of distinct lines among lines; log mean length of words and lines, the spread of word lengths, and the
    entropy of bytes.
    """
    data, offsets = text_arrays(column)
    many = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    text = np.repeat(np.arange(many), np.diff(offsets))
    table = np.bincount(text * 256 + data, minlength=many * 256).reshape(many, 256).astype(np.float64)
    upper, lower, beyond, digits, points, marks, gaps = (table @ _KINDS.T).T
    chance = table / np.maximum(size, 1)[:, None]
    entropy = -(chance * np.log(np.where(chance > 0, chance, 1))).sum(axis=1)

    starts, ends, owner = word_bounds(data, offsets)
    words, length = _sums(owner, None, many), (ends - starts).astype(np.float64)
    kind_of = np.argmax(_KINDS, axis=0)
    kind_of[_KINDS.sum(axis=0) == 0] = 7
    kinds = kind_of[data]
    total = np.zeros((3, len(data) + 1), np.int64)
    for row, own in zip(total, (0, 1, 2)):
        np.cumsum(kinds == own, out=row[1:])
    capitals, small, foreign = (row[ends] - row[starts] for row in total)
    marked = (kinds[starts] == 5) | (kinds[ends - 1] == 5)
    shouted, bare = (capitals > 1) & (small == 0), capitals + small + foreign == 0
    distinct, again = _repeats(owner, word_hashes(data, starts, ends), many)
    mean = _sums(owner, length, many) / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(_sums(owner, (length - mean[owner]) ** 2, many) / np.maximum(words, 1), 0))

    line_starts, line_ends, line_owner = word_bounds(data, offsets, _BREAKS)
    lines = _sums(line_owner, None, many)
    distinct_lines, _ = _repeats(line_owner, word_hashes(data, line_starts, line_ends), many)
    return np.stack([
        np.log1p(size), np.log1p(words), _odds(upper, size), _odds(beyond, size), _odds(digits, size), _odds(points, size), _odds(marks, size), _odds(gaps, size),
        _odds(_sums(owner, marked, many), words), _odds(_sums(owner, shouted, many), words), _odds(_sums(owner, bare, many), words),
        _odds(again, words), _odds(distinct, words), np.log1p(mean), np.log1p(spread), _odds(distinct_lines, lines),
        np.log1p(size / np.maximum(lines, 1)), entropy], axis=1)


STATISTICS = 18


@dataclass(frozen=True)
class Model:
    """Scaling of the statistics, and for each class its mean, the inverse of its Cholesky factor and log constant."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    slope: float
    shift: float

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        rows = (rows - self.centre) / self.scale
        logs = [c - ((rows - m) @ f.T * ((rows - m) @ f.T)).sum(axis=1) / 2 for m, f, c in zip(self.means, self.factors, self.constants)]
        return logs[1] - logs[0]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(rows) + self.shift, -35, 35)))


def shrunk(own: np.ndarray, both: np.ndarray, towards_both: float, towards_identity: float) -> np.ndarray:
    """A class covariance drawn to that of both classes, then to a multiple of the identity."""
    mixed = (1 - towards_both) * own + towards_both * both
    return (1 - towards_identity) * mixed + towards_identity * np.trace(mixed) / len(mixed) * np.eye(len(mixed))


def _densities(rows: np.ndarray, marks: np.ndarray, towards_both: float, towards_identity: float) -> Model:
    centre, scale = rows.mean(axis=0), rows.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rows = (rows - centre) / scale
    classes = [rows[marks == k] for k in (0, 1)]
    own = [np.cov(c.T, bias=True) for c in classes]
    both = sum(len(c) * o for c, o in zip(classes, own)) / len(rows)
    means, factors, constants = [], [], []
    for c, o in zip(classes, own):
        lower = np.linalg.cholesky(shrunk(o, both, towards_both, towards_identity))
        means.append(c.mean(axis=0))
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(len(c) / len(rows)) - np.log(np.diag(lower)).sum())
    return Model(centre, scale, np.array(means), np.array(factors), np.array(constants), 1.0, 0.0)


def _calibrated(difference: np.ndarray, marks: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the differences, by Newton steps with a small ridge."""
    unit = float(np.median(np.abs(difference))) or 1.0
    at, w = np.stack([difference / unit, np.ones(len(difference))], axis=1), np.array([0.5, 0.0])
    at[:, 0] = np.clip(at[:, 0], -20, 20)
    goal = np.where(marks == 1, ((marks == 1).sum() + 1) / ((marks == 1).sum() + 2), 1 / ((marks == 0).sum() + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-at @ w))
        step = np.linalg.solve(at.T @ (at * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), at.T @ (goal - p) - 1e-3 * w)
        w = w + step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
    return max(float(w[0]), 1e-3) / unit, float(w[1])


def fit(rows: np.ndarray, marks: np.ndarray, shrinkage=((0.1, 0.01), (0.3, 0.01), (0.1, 0.1), (0.3, 0.1), (0.6, 0.1), (1.0, 0.05))) -> Model | None:
    """The model of rows of statistics. The shrinkage is the one of ``shrinkage`` with the least log loss on every fifth row
    set aside, whose differences also give the slope and shift; then all rows are learnt from. None if a class has under two rows."""
    if min((marks == 0).sum(), (marks == 1).sum()) < 2:
        return None
    aside = np.zeros(len(rows), bool)
    for k in (0, 1):
        aside[np.flatnonzero(marks == k)[::5]] = True
    best = None
    for pair in shrinkage:
        difference = _densities(rows[~aside], marks[~aside], *pair).difference(rows[aside])
        slope, shift = _calibrated(difference, marks[aside])
        p = 1 / (1 + np.exp(-np.clip(slope * difference + shift, -35, 35)))
        loss = -np.log(np.where(marks[aside] == 1, p, 1 - p)).mean()
        if best is None or loss < best[0]:
            best = loss, pair, slope, shift
    _, pair, slope, shift = best
    whole = _densities(rows, marks, *pair)
    return Model(whole.centre, whole.scale, whole.means, whole.factors, whole.constants, slope, shift)


def _statistic_rows(batches):
    for batch in batches:
        for first, last in batches_of(batch.column(1)):
            part = batch.slice(first, last - first)
            found = statistics(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, STATISTICS, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["label", "found"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality",
          modulus: int = 4, held: int = 2, **options) -> Model | None:
    """Learn from at most ``rows`` labelled documents, none of them held out. Null labels, null keys and labels other than 0 and 1 teach nothing.

    The driver gets the statistics of the sample, a bounded table, and fits the model. None without two rows of each label.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (id_remainder(key, modulus) != held))
    known = known.select(key, F.col(label).cast("int").alias(label)).join(docs.select(key), key, "left_semi")
    sample = chosen_rows(known, label, rows, key)
    texts = docs.select(key, F.col(text).alias("text")).join(F.broadcast(sample), key).select(F.col(label).alias("label"), "text")
    found = texts.mapInArrow(_statistic_rows, "label int, found array<double>").orderBy("label", "found").limit(rows).toArrow()
    if not found.num_rows:
        return None
    return fit(found["found"].combine_chunks().flatten().to_numpy().reshape(-1, STATISTICS), found["label"].to_numpy(), **options)


def _scores(model: Model | None):
    def run(batches):
        for batch in batches:
            for first, last in batches_of(batch.column(1)):
                part = batch.slice(first, last - first)
                found = np.full(len(part), 0.5) if model is None else model.scores(statistics(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["id", "score"])
    return run


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
          modulus: int = 4, held: int = 2) -> DataFrame:
    """One row per document: key, held_out, score, predicted.

    The statistics are of every whole text; a null text counts as empty, and the score of an empty text follows from its
    statistics like any other. Without a model (too few labels) every score is one half. Null keys and repeated rows
    are scored like others; an empty table gives no rows. Other columns are ignored. The key must be an integer.
    """
    scored = (docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_scores(model), "id long, score double"))
    return scored.select(F.col("id").alias(key), (id_remainder("id", modulus) == held).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
