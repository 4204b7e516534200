"""Reviewed schemas (S-4, S-18)."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T


class SchemaRefused(ValueError):
    pass


def fingerprint(columns: Sequence[str]) -> str:
    """A hash of the ordered names."""
    return hashlib.sha256("\x1f".join(columns).encode("utf-8")).hexdigest()


def match_schema(columns: Sequence[str], versions: Mapping[str, Sequence[str]]) -> tuple[str, str]:
    """S-4: (version, fingerprint) of the approved version with exactly these ordered columns."""
    for version, names in versions.items():
        if list(columns) == list(names):
            return version, fingerprint(columns)
    raise SchemaRefused(f"no approved version has these columns: {list(columns)}")


def text_schema(columns: Sequence[str]) -> T.StructType:
    """Every published column as text; types are never inferred."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def evolve(df: DataFrame, incoming: DataFrame, approved: Sequence[str]) -> DataFrame:
    """S-18: missing columns are added as NULL; a column nobody approved is an error."""
    unknown = [c for c in incoming.columns if c not in approved]
    if unknown:
        raise SchemaRefused(f"columns nobody approved: {unknown}")
    return df.unionByName(incoming, allowMissingColumns=True)


def conform(df: DataFrame, approved: Sequence[str]) -> DataFrame:
    """S-11: the approved columns in order, NULL where this file has none."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in approved])
