"""Whitening of embeddings by an incremental eigendecomposition.

Every partition keeps the spectrum of the centred scatter of its vectors by rank-one updates (``spectrum``); the spectra
are combined by successive rank-one updates in rounds of ``FAN_IN``; a last distributed pass, Rayleigh-Ritz over the
basis that came out, gives the eigenvectors to double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placegrid.llm.spectrum import Spectrum
from placegrid.session import materialize

#: Rows that a partition reduces to a triangle before its updates, and partial results that meet in a task.
BLOCK, FAN_IN = 4096, 16
_PARTS = "run long, n long, high array<long>, low array<long>, mean array<double>, first array<double>, second array<double>"


def whole_rows(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id and x, floor(256 c) of every component, of the rows that take part."""
    doubles = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = table.select(F.col(key).cast("long").alias("id"), doubles.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0))
    fits = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0 ** 54)))
    rows = rows.where(fits).select("id", F.transform("x", lambda c: F.floor(c * F.lit(256.0)).cast("long")).alias("x"))
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("x") == (size["size"] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _blocks(batches, column: int = 0, rows: int = BLOCK):
    """Matrices of about ``rows`` rows, put together from the batches."""
    held, many = [], 0
    for batch in batches:
        if len(batch):
            held.append(matrix(batch.column(column)))
            many += len(batch)
        if many >= rows:
            yield np.concatenate(held)
            held, many = [], 0
    if held:
        yield np.concatenate(held)


def _row(run: int, n: int, high, low, mean, first, second) -> dict:
    return {"run": run, "n": n, "high": high, "low": low, "mean": mean, "first": first, "second": second}


def _batch(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64() if k in ("run", "n") else pa.list_(pa.int64() if k in ("high", "low") else pa.float64()))
                                       for k, v in row.items()})


def _carried(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return high + (low >> 32), low & 0xFFFFFFFF


def _spectra(batches):
    """The spectrum and the exact sums, in two parts of 32 bits, of a partition's rows."""
    from pyspark import TaskContext

    spectrum = None
    for rows in _blocks(batches):
        if spectrum is None:
            spectrum, high, low = Spectrum(rows.shape[1]), np.zeros(rows.shape[1], np.int64), np.zeros(rows.shape[1], np.int64)
        spectrum.add_rows(rows.astype(np.float64))
        high, low = _carried(high + (rows >> 32).sum(axis=0), low + (rows & 0xFFFFFFFF).sum(axis=0))
    if spectrum is not None:
        yield _batch(_row(TaskContext.get().partitionId(), spectrum.rows, high, low, spectrum.mean, spectrum.values, spectrum.vectors.ravel()))


def _merge_spectra(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("source")
    size = len(pdf["mean"].iloc[0])
    whole, high, low = Spectrum(size), np.zeros(size, np.int64), np.zeros(size, np.int64)
    for n, h, l, mean, values, vectors in pdf[["n", "high", "low", "mean", "first", "second"]].itertuples(index=False, name=None):
        whole.merge(n, np.array(mean), np.array(values), np.array(vectors).reshape(size, size))
        high, low = _carried(high + np.array(h), low + np.array(l))
    return pd.DataFrame([_row(pdf["run"].iloc[0], whole.rows, high, low, whole.mean, whole.values, whole.vectors.ravel())])


def _merge_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Adds up partial counts, means and centred products."""
    pdf = pdf.sort_values("source")
    size = len(pdf["mean"].iloc[0])
    n, mean, second = 0, np.zeros(size), np.zeros((size, size))
    for m, other, products in pdf[["n", "mean", "second"]].itertuples(index=False, name=None):
        way = np.array(other) - mean
        second += np.array(products).reshape(size, size) + np.outer(way, way) * (n * m / (n + m))
        mean, n = mean + way * (m / (n + m)), n + m
    return pd.DataFrame([_row(pdf["run"].iloc[0], n, [], [], mean, [], second.ravel())])


def _moments(centre: np.ndarray, basis: np.ndarray):
    """Count, mean and centred products of a partition's rows in a basis."""
    def run(batches):
        from pyspark import TaskContext

        size = basis.shape[1]
        n, mean, second = 0, np.zeros(size), np.zeros((size, size))
        for rows in _blocks(batches):
            own = (rows - centre) @ basis
            middle = own.mean(axis=0)
            way, m = middle - mean, len(own)
            second += (own - middle).T @ (own - middle) + np.outer(way, way) * (n * m / (n + m))
            mean, n = mean + way * (m / (n + m)), n + m
        if n:
            yield _batch(_row(TaskContext.get().partitionId(), n, [], [], mean, [], second.ravel()))
    return run


def _combined(parts: DataFrame, merge) -> dict | None:
    """One row of all partial results, ``FAN_IN`` of them in a task, as often as it takes; the last one is for the driver."""
    left = materialize(parts)
    while (many := left.count()) > 1:
        runs = left.agg(F.max("run")).first()[0] + 1
        left = materialize(left.withColumnRenamed("run", "source").withColumn("run", F.floor(F.col("source") / F.lit(FAN_IN)).cast("long"))
                           .groupBy("run").applyInPandas(merge, _PARTS) if runs > 1 else left)
    return left.toArrow().to_pylist()[0] if many else None


def principal(fit: DataFrame) -> dict | None:
    """n, sums (whole numbers), mean, and eigenvalues (falling) and eigenvectors (columns) of the covariance of ``fit`` (x)."""
    found = _combined(fit.mapInArrow(_spectra, _PARTS), _merge_spectra)
    if found is None:
        return None
    n, sums = found["n"], [h * 2 ** 32 + l for h, l in zip(found["high"], found["low"])]
    mean = np.array([s / n for s in sums])
    basis, _ = np.linalg.qr(np.array(found["second"]).reshape(len(mean), -1))  # orthogonal to the last bit
    ritz = _combined(fit.mapInArrow(_moments(mean, basis), _PARTS), _merge_moments)
    values, turn = np.linalg.eigh(np.array(ritz["second"]).reshape(len(mean), -1) / n)
    vectors = (basis @ turn)[:, ::-1]
    vectors /= np.sqrt((vectors ** 2).sum(axis=0))
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(mean))])
    return {"n": n, "sums": sums, "mean": mean, "values": np.maximum(values[::-1], 0), "vectors": vectors}


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of every row; null where it is beyond a long."""
    reach = n * max(int(np.abs(rows).max(initial=0)), 1) + max(map(abs, sums), default=0)
    if reach * reach * rows.shape[1] < 2 ** 63:
        return ((n * rows - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in rows]
    return [value if value < 2 ** 63 else None for value in exact]


def _whiten(n: int, sums: list[int], mean: np.ndarray, basis: np.ndarray):
    def run(batches):
        many = basis.shape[1]
        for batch in batches:
            for first in range(0, len(batch), BLOCK):
                part = batch.slice(first, BLOCK)
                rows = matrix(part.column(1))
                white, away = (rows - mean) @ basis, pa.array(deviations(rows, n, sums), pa.int64())
                at = pa.array(np.repeat(np.arange(len(part)), many))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(part))),
                                                  away.take(at), pa.array(white.ravel())], names=["id", "component", "deviation", "whitened"])
    return run


def whiten(table: DataFrame, components: int = 4, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: each row in the first principal components.

    The spectrum is that of the distinct vectors. Rows with a null or empty vector, or one with a null or a number that is
    not finite, take no part; nor do vectors of another length than most have, and those with a number whose 256-fold no
    long can hold. Null keys and repeated rows are given like others. Components without variance are left out, so a
    table of one distinct vector, like an empty one, gives no rows. A deviation beyond a long is null. Other columns are
    ignored. The key must be an integer. The driver holds matrices of the vector length squared, no rows.
    """
    spark = table.sparkSession
    schema = "id long, component int, deviation long, whitened double"
    rows = whole_rows(table, key, vector)
    fit = materialize(rows.select("x").distinct())
    found = principal(fit)
    values = found["values"] if found else np.zeros(0)
    kept = [k for k in range(min(components, len(values))) if values[k] > 1e-13 * len(values) * values.sum()]
    if not kept:
        return (spark.createDataFrame([], schema).withColumnRenamed("id", key)
                .selectExpr(f"`{key}`", "component", "0L AS n", "deviation", "whitened", "0D AS explained", "0D AS identity_error"))
    basis = found["vectors"][:, kept] / np.sqrt(values[kept])
    white = _combined(fit.mapInArrow(_moments(found["mean"], basis), _PARTS), _merge_moments)
    error = float(np.abs(np.array(white["second"]).reshape(len(kept), -1) / white["n"] - np.eye(len(kept))).max())
    shares = F.array(*[F.lit(float(values[k] / values.sum())) for k in kept])
    out = rows.select("id", "x").mapInArrow(_whiten(found["n"], found["sums"], found["mean"], basis), schema)
    return out.select(F.col("id").alias(key), "component", F.lit(found["n"]).cast("long").alias("n"), "deviation", "whitened",
                      shares[F.col("component") - 1].alias("explained"), F.lit(error).alias("identity_error"))
