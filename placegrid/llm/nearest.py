"""Approximate nearest neighbours with an inverted multi-index.

Both halves of a vector are quantised by a codebook of their own, so a cell is a pair of centroids. A query walks the
pairs in falling summed inner product with a heap until the cells it has met hold a share of all rows, and the rows of
those cells are scored on the original vectors. Cells lie in blocks of bounded size, each met by blocks of queries.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from placegrid.session import materialize

#: Most vectors the codebooks are trained on.
SAMPLE = 8192
#: Most centroids of a half, and rows of a block.
CENTROIDS, BLOCK, QUERIES = 128, 8192, 1024


def codebook(vectors: np.ndarray, count: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's method; fewer if there are fewer vectors."""
    centres = vectors[np.random.default_rng(seed).permutation(len(vectors))[:count]].copy()
    for _ in range(rounds):
        near = nearest_centroid(vectors, centres)
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = vectors[near == k].mean(axis=0)
    return centres


def nearest_centroid(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in rising ``left[i] + right[j]`` until their ``counts`` reach ``wanted``; each step pops one pair of a heap."""
    rows, cols = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    heap, seen, out, total = [(left[rows[0]] + right[cols[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and total < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(rows[i]) * len(right) + int(cols[j])
        if counts[cell]:
            out.append(cell)
            total += counts[cell]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(left) and b < len(right) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (left[rows[a]] + right[cols[b]], a, b))
    return out


def _cells(books):
    def run(batches):
        for pdf in batches:
            vectors = np.stack(pdf["vector"].to_numpy()) if len(pdf) else np.zeros((0, books[0].shape[1] + books[1].shape[1]))
            half = books[0].shape[1]
            pdf["cell"] = nearest_centroid(vectors[:, :half], books[0]) * len(books[1]) + nearest_centroid(vectors[:, half:], books[1])
            yield pdf
    return run


def _asked(books, counts, first_block, blocks_of, wanted):
    """For each query and block that it needs, the cells wanted there."""
    def run(batches):
        half = books[0].shape[1]
        for pdf in batches:
            rows = []
            for query, chunk, vector in pdf[["query", "chunk", "vector"]].itertuples(index=False, name=None):
                cells = np.array(walk(-(books[0] @ vector[:half]), -(books[1] @ vector[half:]), counts, wanted))
                by_block: dict[int, list[int]] = {}
                for cell in cells:
                    for block in range(first_block[cell], first_block[cell] + blocks_of[cell]):
                        by_block.setdefault(int(block), []).append(int(cell))
                rows += [(query, chunk, block, vector, some) for block, some in by_block.items()]
            yield pd.DataFrame(rows, columns=["query", "chunk", "block", "vector", "cells"])
    return run


def _score(keep: int):
    def run(base: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "vec_id": [], "score": []}
        if len(base) and len(asked):
            base = base.sort_values("least")
            cells, ids = base["cell"].to_numpy(), base["ids"].to_numpy()
            scores = np.stack(asked["vector"].to_numpy()) @ np.stack(base["vector"].to_numpy()).T
            for query, wanted, row in zip(asked["query"], asked["cells"], scores):
                at = np.flatnonzero(np.isin(cells, wanted))
                if len(at) > keep:
                    edge = np.partition(row[at], len(at) - keep)[len(at) - keep]
                    at = at[row[at] >= edge]
                found = sorted((-row[k], int(i)) for k in at for i in ids[k])[:keep]
                out["query"] += [query] * len(found)
                out["vec_id"] += [i for _, i in found]
                out["score"] += [-s for s, _ in found]
        return pd.DataFrame(out).astype({"query": "int64", "vec_id": "int64", "score": "float64"})
    return run


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector (doubles) of the rows that take part: of the commonest length, finite, not zero, with an id."""
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = table.select(F.col(key).cast("long").alias("id"), doubles.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (size["n"] if size else 0))


def nearest(table: DataFrame, top: int = 20, every: int = 20, share: float = 0.75, least: int = 2000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` rows with the largest inner product, for ids divisible by ``every``.

    Rows with a null id, or a vector that is null, zero, of another length or holds a null or a number that is not
    finite, take no part. Equal vectors are indexed and asked once, with the ``top + 1`` smallest ids of each, which are
    all that can be returned; so ties go to the smaller id, and a row never finds its own id. A row given again counts once. With too few
    candidates all are returned; an empty table gives no rows. ``share`` of the rows, and ``least`` at least, is what a query
    meets: vectors without clusters need a large share.
    """
    spark = table.sparkSession
    same = Window.partitionBy("vector").orderBy("id")
    rows = materialize(usable(table, key, vector).distinct())
    few = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= top + 1)
    base = materialize(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("least", F.col("ids")[0]))
    total = base.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    sample = np.array([r[0] for r in base.orderBy(F.xxhash64("least")).limit(SAMPLE).select("vector").collect()])
    half, count = max(1, sample.shape[1] // 2), int(min(CENTROIDS, max(2, 2 ** np.floor(np.log2(np.sqrt(total) / 4 + 1e-9)))))
    books = codebook(sample[:, :half], count), codebook(sample[:, half:], count)
    base = materialize(base.mapInPandas(_cells(books), "vector array<double>, ids array<long>, least long, cell long"))
    counts = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for cell, n in base.groupBy("cell").count().collect():  # one row per cell at most
        counts[cell] = n
    first_block, blocks_of = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // BLOCK))
    block, filled = 0, 0
    for cell, n in enumerate(counts):
        if filled and filled + n > BLOCK:
            block, filled = block + 1, 0
        first_block[cell] = block
        block, filled = (block + int(blocks_of[cell]), 0) if blocks_of[cell] > 1 else (block, filled + n)

    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    asked = queries.groupBy("vector").agg(F.min("id").alias("query"))
    chunks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)))
    wanted = asked.select("query", "chunk", "vector").mapInPandas(
        _asked(books, counts, first_block, blocks_of, max(share * total, least)), "query long, chunk long, block long, vector array<double>, cells array<long>")
    placing = F.create_map(*[F.lit(x) for cell in np.flatnonzero(blocks_of > 1) for x in (int(cell), int(blocks_of[cell]))]) if (blocks_of > 1).any() else None
    pieces = F.coalesce(placing[F.col("cell")], F.lit(1)) if placing is not None else F.lit(1)
    starts = F.array(*[F.lit(int(b)) for b in first_block]) if len(first_block) <= 1024 else None
    if starts is not None:
        start = starts[F.col("cell").cast("int")]
    else:
        table_of = F.pandas_udf(lambda c: pd.Series(first_block[c.to_numpy()]), "long", 200)
        start = table_of("cell")
    placed = base.withColumn("block", (start + F.pmod(F.xxhash64("least"), pieces)).cast("long"))
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    found = placed.groupBy("block", "chunk").cogroup(wanted.groupBy("block", "chunk")).applyInPandas(_score(top + 1), "query long, vec_id long, score double")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top + 1).drop("n")
    lists = merged.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("away"), "vec_id"))).alias("found"))
    lists = lists.join(asked.select("query", "vector"), "query")
    mine = queries.select(F.col("id").alias("query_id"), "vector").join(lists, "vector")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    return (mine.select("query_id", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.away")).alias("score")))
