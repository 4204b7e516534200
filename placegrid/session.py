"""Session set-up and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


#: Spark's setting that deletes the shuffle files of a query when it ends.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "placegrid", cores: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the submitted session is used instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is only ever chosen for a local master with nothing configured, as in tests; the setting is
    read-only in a running session, so it is not written back.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.gettempdir(), "placegrid-checkpoints")
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from there.

    Used where a plan is read more than once and must give the same rows each time (a sampled range
    partitioning), or where a loop would otherwise grow its lineage. Survives the loss of executors, and unlike an
    in-memory copy it is read by column and has a known size, so small results can be broadcast. What was shuffled for
    it is deleted as soon as the table is written, not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "stage")
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a table or file set one job writes and reads back."""
    return f"{shared_dir(spark)}/placegrid/{name}-{uuid.uuid4().hex}"


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of fixed rows, as a literal in the plan rather than a shipped dataset."""
    fields = T.StructType.fromDDL(schema).fields
    packs = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(packs))
