"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training sees a bounded sample of labelled rows. Per-coordinate rates and the L1 term leave few weights, which go to
the tasks that score all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placegrid.llm.common import PUNCTUATION, batches_of, chosen_rows, held as kept_by_worker, id_remainder, let_go, mix, text_arrays, word_bounds, word_hashes

BITS = 20
#: Most labelled rows that training may see, half of them of each label where there are as many.
TRAIN_ROWS = 4_000
THRESHOLD = 0.7
#: Bytes of text whose features are found at a time, about; the arrays for it take many times as many.
BYTES = 1 << 20


@dataclass(frozen=True)
class Model:
    """Features with a weight other than zero, in order, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features and text numbers: each word, each pair of neighbours, each pair with one word between."""
    starts, ends, text = word_bounds(*(arrays := text_arrays(column)), PUNCTUATION)
    words = word_hashes(arrays[0], starts, ends)
    found, owner = [mix(words)], [text]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        left, right = words[:-gap], words[gap:]
        same = text[:-gap] == text[gap:]
        found.append(mix(left * np.uint64(0x9E3779B97F4A7C15) + right + np.uint64(salt))[same])
        owner.append(text[:-gap][same])
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owner)


def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs in order."""
    found, owner = features(column)
    pairs = np.unique((owner.astype(np.int64) << BITS) | found)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def fit(examples: list[np.ndarray], labels: list[int], alpha: float = 4.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0,
        rounds: int = 4, seed: int = 7) -> Model:
    """FTRL-proximal over examples of distinct features. Without examples the score is one half, with no weight."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(seed)

    def weights(zs, ns):
        return np.where(np.abs(zs) > l1, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2), 0.0)

    def bias():
        return -bias_z / ((beta + np.sqrt(bias_n)) / alpha)

    for _ in range(rounds):
        for k in rng.permutation(len(examples)):
            at = examples[k]
            w = weights(z[at], n[at])
            miss = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias(), -35, 35))) - labels[k]
            rate = (np.sqrt(n[at] + miss * miss) - np.sqrt(n[at])) / alpha
            z[at] += miss - rate * w
            n[at] += miss * miss
            rate = (np.sqrt(bias_n + miss * miss) - np.sqrt(bias_n)) / alpha
            bias_z += miss - rate * bias()
            bias_n += miss * miss
    final = weights(z, n)
    kept = np.flatnonzero(final)
    return Model(kept, final[kept], float(bias()))


def _example_rows(batches):
    let_go()
    for batch in batches:
        for first, last in batches_of(batch.column(1), BYTES):
            part = batch.slice(first, last - first)
            owner, found = _distinct(part.column(1))
            cuts = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.astype(np.int32)))],
                                             names=["label", "found"])


def _fitted(options: dict):
    """Fits in the task that holds the bounded sample; only the weights leave it."""
    def run(batches):
        marks, examples = [], []
        for batch in batches:
            marks += batch.column(0).to_pylist()
            flat, cuts = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            examples += [flat[a:b].copy() for a, b in zip(cuts, cuts[1:])]
        order = sorted(range(len(marks)), key=lambda k: (marks[k], examples[k].tobytes()))
        model = fit([examples[k] for k in order], [marks[k] for k in order], **options)
        yield pa.RecordBatch.from_pydict({"features": pa.array([model.features], pa.list_(pa.int64())),
                                          "weights": pa.array([model.weights], pa.list_(pa.float64())), "bias": [model.bias]})
    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text",
          label: str = "toxic", modulus: int = 3, held: int = 1, **options) -> Model:
    """Learn from at most ``rows`` labelled documents, none of them held out. Null labels and null keys teach nothing."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (id_remainder(key, modulus) != held))
    known = known.select(key, F.col(label).cast("int").alias(label)).join(docs.select(key), key, "left_semi")
    sample = chosen_rows(known, label, rows, key)
    texts = docs.select(key, F.col(text).alias("text")).join(F.broadcast(sample), key).select(F.col(label).alias("label"), "text")
    fitted = (texts.mapInArrow(_example_rows, "label int, found array<int>").limit(rows).coalesce(1)
              .mapInArrow(_fitted(options), "features array<long>, weights array<double>, bias double").toArrow())
    if not fitted.num_rows:
        return fit([], [], **options)
    one = [fitted[c].combine_chunks() for c in ("features", "weights", "bias")]
    return Model(one[0].values.to_numpy().copy(), one[1].values.to_numpy().copy(), one[2][0].as_py())


def _scores(model: Model):
    def run(batches):
        table = kept_by_worker(("toxicity",), lambda: np.zeros(1 << BITS))
        table[:] = 0
        table[model.features] = model.weights
        for batch in batches:
            for first, last in batches_of(batch.column(1), BYTES):
                part = batch.slice(first, last - first)
                found, owner = features(part.column(1))
                hit = np.flatnonzero(table[found])
                pairs = np.unique((owner[hit].astype(np.int64) << BITS) | found[hit])
                total = np.bincount(pairs >> BITS, weights=table[pairs & ((1 << BITS) - 1)], minlength=len(part)) + model.bias
                yield pa.RecordBatch.from_arrays([*part.columns[:1], pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))), *part.columns[1:]],
                                                 names=["__id", "__score", *batch.schema.names[1:]])
    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
          modulus: int = 3, held: int = 1) -> DataFrame:
    """One row per document: key, held_out, score, predicted.

    Every whole text is scored by the distinct features it has; a null text counts as empty and scores the bias.
    Null keys and repeated rows are scored like others; an empty table gives no rows. Other columns are ignored.
    The key must be an integer.
    """
    scored = (docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
              .mapInArrow(_scores(model), "__id long, __score double, __text string").drop("__text"))
    return scored.select(F.col("__id").alias(key), (id_remainder("__id", modulus) == held).alias("held_out"),
                         F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score under the threshold, with all their columns; each text is scored where it is read."""
    columns = docs.columns
    wide = docs.select(F.lit(0).alias("__id"), F.col(text).alias("__text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    schema = "__id int, __score double, __text string, " + ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(columns))
    return (wide.mapInArrow(_scores(model), schema).where(F.col("__score") < threshold)
            .select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]))
