"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by SGD in numpy.

A document is the mean of the embeddings of its byte 2- to 4-grams within and around words. A held-back part of the
sample calibrates the confidence (a temperature) and the score under which a prediction is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placegrid.llm.common import batches_of, chosen_rows, held as kept_by_worker, id_remainder, text_arrays

BITS = 16
SIZES = (2, 3, 4)
UNKNOWN = "und"
#: Most labelled rows that training and calibration may see, taken evenly from all languages.
TRAIN_ROWS = 2_000

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[_c] = _FOLD[_c - 32] = _c


@dataclass(frozen=True)
class Model:
    """Per bucket and language the product of embedding and softmax weights, and what calibration found."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(data: np.ndarray, offsets: np.ndarray):
    """For each size, the buckets of all n-grams that lie inside one text and begin or end in a letter, and their places."""
    folded = _FOLD[data]
    end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(len(folded))
    hashed = np.zeros(len(folded), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(folded) < n:
            return
        hashed = hashed[:len(folded) - n + 1] * np.uint32(0x01000193) + folded[n - 1:]
        if n in SIZES:
            full = (place[:len(hashed)] + n <= end[:len(hashed)]) & ((folded[:len(hashed)] != 32) | (folded[n - 1:] != 32))
            value = (hashed[full] + np.uint32(n)) * np.uint32(0x85EBCA6B)
            value = (value ^ (value >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            yield value >> np.uint32(32 - BITS), np.flatnonzero(full)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[str], width: int = 16, rounds: int = 4, rate: float = 2.0,
        lost: float = 0.0, seed: int = 11) -> Model:
    """Train on four of five examples and calibrate on the fifth; an example is its buckets and their shares.

    The temperature is the one of a fixed grid with the least calibration loss. The threshold is the confidence that
    all but the share ``lost`` of rightly predicted calibration examples reach, and one half at most.
    """
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    wanted = np.array([languages.index(x) for x in labels])
    held = np.arange(len(labels)) % 5 == 4
    vectors = rng.uniform(-1 / width, 1 / width, (1 << BITS, width))
    weights, bias = np.zeros((width, len(languages))), np.zeros(len(languages))
    trained = np.flatnonzero(~held)
    for step, k in enumerate(np.concatenate([rng.permutation(trained) for _ in range(rounds)])):
        pace = rate * (1 - step / (rounds * len(trained)))
        at, share = examples[k]
        mean = share @ vectors[at]
        miss = _softmax(mean @ weights + bias)
        miss[wanted[k]] -= 1
        back = weights @ miss
        weights -= pace * np.outer(mean, miss)
        bias -= 0.1 * pace * miss
        vectors[at] -= (pace * share * len(at) ** 0.5)[:, None] * back
    table = (vectors @ weights).astype(np.float32)
    check = np.flatnonzero(held) if held.any() else trained
    logits = np.array([examples[k][1] @ table[examples[k][0]] for k in check]) + bias
    truth = wanted[check]

    def loss(t):
        return -np.log(np.maximum(_softmax(logits / t)[np.arange(len(check)), truth], 1e-12)).mean()

    temperature = float(min(2.0 ** np.arange(-3, 3.25, 0.25), key=loss))
    sure = _softmax(logits / temperature)
    right = sure.argmax(axis=1) == truth
    threshold = min(0.5, float(np.quantile(sure.max(axis=1)[right], lost))) if right.any() else 0.0
    return Model(languages, table, bias, temperature, threshold)


def _example_rows(batches):
    for batch in batches:
        for k in range(len(batch)):
            data, offsets = text_arrays(batch.column(1).slice(k, 1))
            counted = np.bincount(np.concatenate([b for b, _ in subwords(data, offsets)] or [np.zeros(0, np.int64)]), minlength=1 << BITS)
            at = np.flatnonzero(counted)
            cuts = pa.array([0, len(at)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.ListArray.from_arrays(cuts, pa.array(at, pa.int32())),
                                              pa.ListArray.from_arrays(cuts, pa.array(counted[at], pa.int32()))], names=["label", "at", "times"])


def _fitted(options: dict):
    """Fits in the task that holds the bounded sample; only the model leaves it. Examples go in an order of their own."""
    def run(batches):
        rows = []
        for batch in batches:
            at, times = batch.column(1), batch.column(2)
            cuts, at, times = at.offsets.to_numpy(), at.values.to_numpy(), times.values.to_numpy()
            rows += [(name, at[a:b].copy(), times[a:b].copy()) for name, a, b in zip(batch.column(0).to_pylist(), cuts, cuts[1:]) if a < b]
        rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
        rows = [rows[k] for k in np.random.default_rng(3).permutation(len(rows))]
        model = fit([(at, times / times.sum()) for _, at, times in rows], [name for name, _, _ in rows], **options)
        yield pa.RecordBatch.from_pydict({
            "languages": pa.array([model.languages], pa.list_(pa.string())), "weights": pa.array([model.table.tobytes()], pa.binary()),
            "bias": pa.array([model.bias], pa.list_(pa.float64())), "temperature": [model.temperature], "threshold": [model.threshold]})
    return run


def train(docs: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", label: str = "lang",
          modulus: int = 4, held: int = 2, **options) -> Model:
    """Learn from at most ``rows`` documents with a language, none of them held out. Empty and null texts teach nothing."""
    known = docs.where(F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike("[A-Za-z\\x80-\\x{10FFFF}]")
                       & (id_remainder(key, modulus) != held)).select(key, label)
    sample = chosen_rows(known, label, rows, key).withColumnRenamed(label, "label")
    texts = docs.select(key, F.col(text).alias("text")).join(F.broadcast(sample), key).select("label", "text")
    fitted = (texts.mapInArrow(_example_rows, "label string, at array<int>, times array<int>").limit(rows).coalesce(1)
              .mapInArrow(_fitted(options), "languages array<string>, weights binary, bias array<double>, temperature double, threshold double").toArrow())
    if not fitted.num_rows:
        return fit([], [], **options)
    one = fitted.to_pylist()[0]
    table = np.frombuffer(one["weights"], np.float32).reshape(1 << BITS, len(one["languages"]))
    return Model(one["languages"], table, np.array(one["bias"], np.float64), one["temperature"], one["threshold"])


def _has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = np.zeros(len(data) + 1, np.int64)
    np.cumsum((_FOLD[data] != 32) & (data < 128), out=plain[1:])
    found = plain[offsets[1:]] > plain[offsets[:-1]]
    for k in np.flatnonzero(~found):
        found[k] = any(c.isalpha() for c in column[int(k)].as_py() or "")
    return found


def _predictions(model: Model):
    def run(batches):
        kept_by_worker(("language",), lambda: None)  # what an earlier stage kept in this worker goes
        names = np.array([*model.languages, UNKNOWN])
        for batch in batches:
            for first, last in batches_of(batch.column(1), 1 << 20):
                part = batch.slice(first, last - first)
                data, offsets = text_arrays(part.column(1))
                total, count = np.zeros((len(part), len(model.languages))), np.zeros(len(part))
                for bucket, place in subwords(data, offsets):
                    cuts = np.searchsorted(place, offsets)
                    sums = np.zeros((len(bucket) + 1, len(model.languages)))
                    np.cumsum(model.table[bucket], axis=0, dtype=np.float64, out=sums[1:])
                    total += sums[cuts[1:]] - sums[cuts[:-1]]
                    count += np.diff(cuts)
                usable = _has_letter(part.column(1), data, offsets) & (len(model.languages) > 0)
                best, sure = np.full(len(part), len(model.languages)), np.zeros(len(part))
                if usable.any():
                    chance = _softmax((total[usable] / np.maximum(count[usable], 1)[:, None] + model.bias) / model.temperature)
                    best[usable], sure[usable] = chance.argmax(axis=1), chance.max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(sure),
                     pa.array(~usable | (sure < model.threshold)), *part.columns[1:]],
                    names=["__id", "__lang", "__score", "__rejected", *batch.schema.names[1:]])
    return run


_FOUND = "__id long, __lang string, __score double, __rejected boolean, __text string"


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", modulus: int = 4, held: int = 2) -> DataFrame:
    """One row per document: key, held_out, lang_pred, score, rejected.

    Whole texts are read. A null text or one without a letter is ``und`` with score 0 and rejected; otherwise a learned
    language with its calibrated probability, rejected if that is under the calibrated threshold. Null keys and
    repeated rows are predicted like others; an empty table gives no rows. Other columns are ignored. The key must be
    an integer.
    """
    found = (docs.select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
             .mapInArrow(_predictions(model), _FOUND))
    return found.select(F.col("__id").alias(key), (id_remainder("__id", modulus) == held).alias("held_out"), F.col("__lang").alias("lang_pred"),
                        F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns; each text is judged where it is read."""
    columns = docs.columns
    wide = docs.select(F.lit(0).cast("long").alias("__id"), F.col(text).alias("__text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    schema = _FOUND + ", " + ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(columns))
    return (wide.mapInArrow(_predictions(model), schema).where(~F.col("__rejected"))
            .select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)]))
