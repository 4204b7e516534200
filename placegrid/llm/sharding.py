"""Sharding by jump consistent hashing.

A stable key and the number of shards decide; there is no ring table, and one more shard takes rows only into itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from placegrid.llm.common import exclusive_offsets
from placegrid.session import materialize

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key by the published jump consistent hash, all keys at once."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64).copy()
    chosen, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        chosen[moving] = ahead[moving]
        state[moving] = state[moving] * _STEP + np.uint64(1)
        ahead[moving] = ((chosen[moving] + 1) * (float(1 << 31) / ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return chosen


def _both(keys: pd.Series, shards: pd.Series) -> pd.DataFrame:
    values, n = keys.to_numpy(np.int64).view(np.uint64), int(shards.iloc[0])
    return pd.DataFrame({"shard": jump(values, n).astype(np.int32), "grown_shard": jump(values, n + 1).astype(np.int32)})


def _shards(hashed, shards):
    return F.pandas_udf(_both, "struct<shard:int,grown_shard:int>")(hashed, F.lit(shards))


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    The shard is the jump hash of the key's 64-bit hash (a null key hashes like any other value). Slots number each
    shard's rows from 0 without gaps: rows are counted per (input partition, shard), the counts become offsets, and
    rows are numbered by key inside their partition only. Null texts have size 1. Repeated rows each get a slot; an
    empty table gives no rows. Other columns are ignored.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    hashed = F.coalesce(F.xxhash64(F.col(key)), F.lit(0))
    both = _shards(hashed, shards)
    narrow = (docs.select(F.col(key).alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                          F.crc32(raw.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"), both.alias("to"))
              .select("id", "size", "text_crc32", "part", "to.shard", "to.grown_shard"))
    narrow = materialize(narrow)
    counts = narrow.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    offsets = exclusive_offsets(counts, ["shard"], "part", "rows", "base").drop("rows")
    inside = Window.partitionBy("shard", "part").orderBy("id", "text_crc32")
    return (narrow.withColumn("n", F.row_number().over(inside)).join(offsets, ["shard", "part"])
            .select(F.col("id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("base") + F.col("n") - 1).cast("long").alias("slot"), "grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id", pieces: int = 8) -> None:
    """Write ``docs`` as one folder per shard, each in up to ``pieces`` files dealt by a hash of the whole row's key."""
    hashed = F.coalesce(F.xxhash64(F.col(key)), F.lit(0))
    placed = docs.withColumn("shard", _shards(hashed, shards)["shard"])
    placed.repartition(shards * pieces, "shard", F.pmod(F.xxhash64(*docs.columns), F.lit(pieces))).write.partitionBy("shard").parquet(path)
