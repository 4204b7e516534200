"""Insert-only loading of a landing folder, as a stream that stops when it has caught up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from placegrid.sources.ingest import insert_only


def load_landing(spark: SparkSession, landing: str, schema: StructType, table: str, checkpoint: str,
                 key: Sequence[str], max_files: int = 1000, **options) -> None:
    """New files in ``landing`` are appended to ``table`` once each; a rerun or a redelivered row adds nothing.

    The file source remembers which files it took; ``insert_only`` covers rows delivered again in another file and
    a batch that is repeated after a failure.
    """
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).options(**options)
              .format("csv").load(landing))

    def append(batch: DataFrame, _: int) -> None:
        try:
            existing = spark.read.parquet(table)
        except Exception as error:  # the table does not exist before its first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            existing = batch.limit(0)
        insert_only(existing, batch, key).write.mode("append").parquet(table)

    query = (stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
