"""Row rules, quarantine and duplicates (C-12 to C-16, C-21, C-39, C-40)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F


def with_reasons(df: DataFrame, rules: Mapping[str, Column], name: str = "quarantine_reasons") -> DataFrame:
    """C-12: the ordered list of rules a row breaks; never NULL, empty for a clean row."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items()]))
    return df.withColumn(name, found)


def split_clean(df: DataFrame, name: str = "quarantine_reasons") -> tuple[DataFrame, DataFrame]:
    """C-13: (clean, quarantine); every row is in exactly one of the two."""
    return df.filter(F.size(name) == 0).drop(name), df.filter(F.size(name) > 0)


def with_copies(df: DataFrame, key: Sequence[str], name: str = "key_rows") -> DataFrame:
    """C-14: how many rows share the key, on every one of them.

    Counted by aggregate and joined back, so only keys that repeat travel and a hot key stays spread out.
    """
    repeated = df.groupBy(*key).agg(F.count("*").alias(name)).filter(F.col(name) > 1)
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    return (df.alias("l").join(repeated.alias("r"), same, "left")
            .select("l.*", F.coalesce(f"r.{name}", F.lit(1)).cast("bigint").alias(name)))


def with_versions(df: DataFrame, key: Sequence[str], content: Sequence[str], row: str) -> DataFrame:
    """C-15: per key the row count, the number of different contents and whether this is the first copy."""
    text = F.to_json(F.array(*[F.col(c).cast("string") for c in content]))  # quotes values, tells NULL from blank
    hashed = df.withColumn("_content", F.md5(text))
    # contents are counted in two steps, so a key with very many rows is combined before it is shuffled
    contents = hashed.groupBy(*key, "_content").agg(F.count("*").alias("_n"), F.min(row).alias("_row"))
    groups = contents.groupBy(*key).agg(
        F.sum("_n").alias("key_rows"), F.count("*").alias("key_versions"), F.min("_row").alias("_first"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    return (hashed.drop("_content").alias("l").join(groups.alias("r"), same)
            .select("l.*", "r.key_rows", "r.key_versions", (F.col(f"l.{row}") == F.col("r._first")).alias("is_first_copy")))


def duplicate_rules() -> dict[str, Column]:
    """C-15: identical copies keep the first row; conflicting rows are all set aside."""
    return {
        "key_conflicting": (F.col("key_rows") > 1) & (F.col("key_versions") > 1),
        "key_identical_copy": (F.col("key_rows") > 1) & (F.col("key_versions") == 1) & ~F.col("is_first_copy"),
    }


def with_known_parent(df: DataFrame, code: str, digits: int, length: int, is_parent: Column, name: str,
                      by: Sequence[str] = ()) -> DataFrame:
    """C-21: the parent code by position, kept only where a row of that code is a parent in the same delivery."""
    parents = (df.filter(F.col(code).rlike(f"^[0-9]{{{length}}}$") & F.coalesce(is_parent, F.lit(False)))
               .select(*by, F.col(code).alias(name)).distinct())
    keyed = df.withColumn("_parent", F.rpad(F.substring(code, 1, digits), length, "0"))
    same = [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by] + [F.col("l._parent") == F.col(f"r.{name}")]
    return keyed.alias("l").join(parents.alias("r"), same, "left").select("l.*", f"r.{name}").drop("_parent")


def only_current(df: DataFrame, current: DataFrame, key: str = "batch_id") -> DataFrame:
    """C-39: rows of current, succeeded batches."""
    return df.join(current.select(key).distinct(), key, "left_semi")


def stamp(df: DataFrame, run_id: str, built_at: datetime, code_revision: str) -> DataFrame:
    """C-40: one run stamp per build, taken once on the driver."""
    return df.withColumns({"run_id": F.lit(run_id), "cleaned_at_utc": F.lit(built_at).cast("timestamp"),
                           "code_revision": F.lit(code_revision)})
