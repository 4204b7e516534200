"""Exact dedup by a tree merge of sorted digest runs.

Each input partition gives one sorted run of digests per digest range. In binomial rounds the runs of a range are
merged ``fan_in`` at a time until one is left; every level keeps a single entry per text with its verified smallest
candidate and the number of copies. Texts themselves are never moved.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from placegrid.llm.common import GAPS
from placegrid.session import materialize

_RUN = pa.schema([("range", pa.int32()), ("run", pa.int64()), ("digest", pa.string()), ("check_hash", pa.int64()), ("check_bytes", pa.int64()),
                  ("points", pa.int64()), ("id", pa.int64()), ("place", pa.int64()), ("copies", pa.int64())])
_RUN_TEXT = "range int, run long, digest string, check_hash long, check_bytes long, points long, id long, place long, copies long"


def normalised(text: str) -> Column:
    """The text without the six separator characters; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), GAPS, "")


def _merge(batches):
    """Multiway merge of the sorted runs of each (range, target run) in a partition.

    An entry is the same text only if digest, second hash and length agree; of the same text the longest original,
    then the smallest identifier (a missing one last), then the first place stays. Identifiers stay whole numbers.
    """
    runs: dict[tuple, dict] = {}
    for batch in batches:
        for part, target, source, *entry in zip(*[c.to_pylist() for c in batch.columns]):
            runs.setdefault((part, target), {}).setdefault(source, []).append(entry)
    for (part, target), sources in runs.items():
        out = []
        merged = heapq.merge(*[sorted(run, key=_order) for run in sources.values()], key=_order)
        for key, same in groupby(merged, key=lambda e: e[:3]):
            same = list(same)
            best = min(same, key=lambda e: (-e[3], e[4] is None, e[4] or 0, e[5]))
            out.append((part, target, *key, *best[3:6], sum(e[6] for e in same)))
        yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*out), _RUN.types)], schema=_RUN)


def _order(entry: list) -> tuple:
    """Entries by digest, second hash and length."""
    return tuple(entry[:3])


def text_groups(marked: DataFrame, ranges: int, fan_in: int = 16) -> DataFrame:
    """One row per distinct text: digest, the candidate that stays and the number of copies.

    ``marked`` has digest, check_hash, check_bytes, points, id, place and run of every document.
    """
    best = F.min(F.struct(-F.col("points"), F.col("id").isNull(), F.col("id"), F.col("place")))
    spread = F.conv(F.substring("digest", 1, 7), 16, 10).cast("long") % F.lit(ranges)
    runs = (marked.groupBy(spread.cast("int").alias("range"), "run", "digest", "check_hash", "check_bytes")
            .agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
            .select("range", "run", "digest", "check_hash", "check_bytes", (-F.col("best.col1")).alias("points"),
                    F.col("best.id").alias("id"), F.col("best.place").alias("place"), "copies"))
    left = (marked.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        dealt = (runs.select("range", F.floor(F.col("run") / fan_in).alias("target"), F.col("run").alias("source"), "digest",
                             "check_hash", "check_bytes", "points", "id", "place", "copies")
                 .repartition(ranges, "range", "target"))
        runs = dealt.mapInArrow(_merge, _RUN_TEXT)
        left = -(-left // fan_in)
        if left == 1:
            return runs.drop("range", "run")
        runs = materialize(runs)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without separator characters. Of equal texts the row with the most code
    points stays, then the smallest key; a null key comes last, and of rows alike in both the first read stays, so
    repeated rows leave exactly one. Null texts equal empty ones. An empty table gives no rows; other columns of
    ``docs`` are ignored. The key must be an integer.
    """
    text_col = normalised(text)
    marked = materialize(docs.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("points"),
        F.sha2(text_col, 256).alias("digest"), F.xxhash64(text_col).alias("check_hash"),
        F.octet_length(text_col).cast("long").alias("check_bytes"), F.monotonically_increasing_id().alias("place"),
        F.spark_partition_id().cast("long").alias("run")))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(ranges, marked.count() // 200_000)
    groups = text_groups(marked, ranges, fan_in).select(
        "digest", "check_hash", "check_bytes", F.col("id").alias("keep_id"), F.col("place").alias("keep_place"),
        F.col("copies").alias("group_size"))
    return (marked.join(groups, ["digest", "check_hash", "check_bytes"])
            .select(F.col("id").alias(key), "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"),
                    F.col("digest").alias("text_sha256")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that ``exact_dedup`` keeps, with all their columns, whatever these are called.

    The kept (key, digest) pairs are joined back. Repeated rows share one pair, so one of them is picked afterwards.
    """
    columns = docs.columns
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
    own, body = f"c{columns.index(key)}", f"c{columns.index(text)}"
    same = ["id", "missing", "digest"]  # one dealing of the rows serves the join and the window
    named = lambda column: [F.coalesce(F.col(column).cast("long"), F.lit(0)).alias("id"), F.col(column).isNull().alias("missing")]
    kept = exact_dedup(wide, own, body).where("kept").select(*named(own), F.col("text_sha256").alias("digest"))
    marked = wide.select("*", *named(own), F.sha2(normalised(body), 256).alias("digest"), F.coalesce(F.length(body), F.lit(0)).alias("points"))
    joined = marked.join(kept, same, "left_semi")
    one = Window.partitionBy(*same).orderBy(F.desc("points"))
    return joined.withColumn("turn", F.row_number().over(one)).where("turn = 1").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])
