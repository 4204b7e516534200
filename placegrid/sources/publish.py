"""Candidate tables, publication behind a gate, content hashes (S-19 to S-21).

A candidate is written once under its run. Publishing appends one row to a small ledger that names the run and the
published columns; readers follow the newest ledger row. Nothing is rewritten to publish it, and a failed gate
leaves the published table as it was.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from placegrid.operators.gates import record_and_raise

LEDGER_SCHEMA = "table_name string, run_id string, columns array<string>, published_at timestamp"


def write_candidate(df: DataFrame, root: str, table: str, run_id: str) -> DataFrame:
    """S-19: writes ``<root>/<table>/run_id=...`` and returns it as written."""
    path = f"{root}/{table}/run_id={run_id}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def publish(candidate: DataFrame, root: str, table: str, run_id: str, checks: DataFrame,
            columns: Sequence[str] | None = None, results_path: str | None = None) -> None:
    """S-19/S-20: publishes the candidate, with the chosen columns, only if no check failed."""
    record_and_raise(checks, results_path)
    chosen = list(columns or candidate.columns)
    row = [(table, run_id, chosen, datetime.now(timezone.utc))]
    candidate.sparkSession.createDataFrame(row, LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/_published")


def read_published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The newest published run of a table. Reads one ledger row."""
    newest = (spark.read.schema(LEDGER_SCHEMA).parquet(f"{root}/_published").filter(F.col("table_name") == table)
              .agg(F.max(F.struct("published_at", "run_id", "columns")).alias("p")).select("p.*").collect()[0])
    if newest["run_id"] is None:
        raise LookupError(f"{table} has never been published")
    return spark.read.parquet(f"{root}/{table}/run_id={newest['run_id']}").select(*newest["columns"])


def content_hash(df: DataFrame, without: Sequence[str] = ()) -> DataFrame:
    """S-21: one row with the row count and a hash of the contents, whatever the row order.

    Both halves of the row digests are added, so partial sums combine before the shuffle and nothing has to be sorted;
    a repeated row changes the sums. Values carry their length and NULL its own mark, so no two rows read alike.
    """
    columns = sorted(c for c in df.columns if c not in without)
    texts = [F.col(c).cast("string") for c in columns]
    framed = F.concat_ws("", *[F.when(t.isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(t), F.lit(":"), t)) for t in texts])
    digest = F.md5(framed)

    def half(start):
        return F.coalesce(F.sum(F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")

    return df.agg(F.count("*").alias("row_count"), F.concat_ws("-", half(1), half(17)).alias("content_sum"))
