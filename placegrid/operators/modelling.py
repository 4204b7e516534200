"""Dimensions and facts of the star (G-1 to G-14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.session import literal_table
from placegrid.rules import EXCLUDED, UNKNOWN


def latest_value(df: DataFrame, key: Sequence[str], value: str, order: str, name: str | None = None) -> DataFrame:
    """G-1: the newest non-null value per key (keys without one keep NULL)."""
    known = F.when(F.col(value).isNotNull(), F.col(order))
    return df.groupBy(*key).agg(F.max_by(value, known).alias(name or value))


def distinct_dimension(df: DataFrame, columns: Sequence[str], derived: Mapping[str, Column]) -> DataFrame:
    """G-2: distinct members with columns worked out from them."""
    return df.select(*columns).filter(F.col(columns[0]).isNotNull()).distinct().withColumns(dict(derived))


def with_parent_names(df: DataFrame, code: str, name: str, parents: Mapping[str, str]) -> DataFrame:
    """G-4: names of several parents looked up in the same table (``{new column: parent code column}``)."""
    names = df.select(F.col(code).alias("_code"), F.col(name).alias("_name"))
    for new, parent in parents.items():
        df = (df.join(names.select(F.col("_code").alias(parent), F.col("_name").alias(new)), parent, "left"))
    return df


def with_technical_members(df: DataFrame, key: str, label: str, members: Mapping[str, tuple[str, str]] | None = None,
                           member_type: str = "member_type") -> DataFrame:
    """G-5: regular rows plus the rows that stand in for a missing key."""
    members = members or {UNKNOWN: ("Unknown", "unknown"), EXCLUDED: ("Excluded from analysis", "excluded")}
    rows = [(code, text, kind) for code, (text, kind) in members.items()]
    kind = df.schema[key].dataType.simpleString()
    technical = literal_table(df.sparkSession, rows, f"`{key}` {kind}, `{label}` string, `{member_type}` string")
    return df.withColumn(member_type, F.lit("regular")).unionByName(technical, allowMissingColumns=True)


def with_unknown_children(children: DataFrame, parents: DataFrame, key: str, label: str, parent: str) -> DataFrame:
    """G-5: one '<parent>-UNKNOWN' member per regular parent."""
    unknown = parents.select(F.concat_ws("-", parent, F.lit(UNKNOWN)).alias(key), F.lit("Unknown").alias(label),
                             F.col(parent), F.lit("unknown").alias("member_type"))
    return children.withColumn("member_type", F.lit("regular")).unionByName(unknown, allowMissingColumns=True)


def latest_release(df: DataFrame, release: str) -> DataFrame:
    """G-6: rows of the newest release; the maximum is one scalar, not a join."""
    return df.filter(F.col(release) == df.agg(F.max(release)).scalar())


def melt_levels(df: DataFrame, keep: Sequence[str], levels: Mapping[str, tuple[str, Sequence[str | tuple[str, Column]]]]) -> DataFrame:
    """G-7: one row per level from ``{level: (offered column, cells)}``.

    A cell is a column, or ``(column, condition)`` when it only applies to some rows. The count is 0 when the level
    is not offered, the sum when every applicable cell is filled, NULL otherwise. Audit columns say why.
    """
    packs = []
    for level, (offered, cells) in levels.items():
        pairs = [(c, F.lit(True)) if isinstance(c, str) else c for c in cells]
        applies = [F.coalesce(w, F.lit(False)) for _, w in pairs]
        one = lambda c: c.cast("int")
        applicable = sum((one(a) for a in applies), F.lit(0))
        missing = sum((one(a & F.col(c).isNull()) for (c, _), a in zip(pairs, applies)), F.lit(0))
        total = sum((F.when(a, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
                     for (c, _), a in zip(pairs, applies)), F.lit(0).cast("bigint"))
        packs.append(F.struct(F.lit(level).alias("level_code"), F.col(offered).alias("is_offered"),
                              applicable.alias("applicable_cells"), missing.alias("null_cells"),
                              total.alias("published_cell_sum")))
    rows = df.select(*keep, F.explode(F.array(*packs)).alias("_l")).select(*keep, "_l.*")
    return rows.withColumn("learner_count", F.when(F.col("is_offered").isNull(), F.lit(None).cast("bigint"))
                           .when(~F.col("is_offered"), F.lit(0).cast("bigint"))
                           .when(F.col("null_cells") == 0, F.col("published_cell_sum")))


def status_to_key(status: Column, code: Column) -> Column:
    """G-9: the matched code, or the technical member its status calls for."""
    return (F.when(status == "matched", code).when(status == "excluded", EXCLUDED)
            .when(status.isin("unmatched", "ambiguous"), UNKNOWN))


def status_to_child_key(parent_status: Column, parent_code: Column, child_status: Column, child_code: Column) -> Column:
    """G-9: the matched child, else its parent's unknown child, else the parent's technical member."""
    return (F.when((parent_status == "matched") & F.coalesce(child_status == "matched", F.lit(False)), child_code)
            .when(parent_status == "matched", F.concat_ws("-", parent_code, F.lit(UNKNOWN)))
            .otherwise(status_to_key(parent_status, parent_code)))


def left_with_status(members: DataFrame, values: DataFrame, key: Sequence[str], status: str, reasons: Sequence[tuple[Column, str]],
                     found: str = "available") -> DataFrame:
    """G-10: every member, its values where there are any, and a status saying why not."""
    joined = members.join(values.withColumn("_found", F.lit(True)), list(key), "left")
    expr = None
    for condition, text in [*reasons, (F.col("_found").isNull(), "not_in_source")]:
        condition = F.coalesce(condition, F.lit(False))
        expr = F.when(condition, text) if expr is None else expr.when(condition, text)
    return joined.withColumn(status, expr.otherwise(found)).drop("_found")


def sum_into_members(df: DataFrame, keys: Sequence[str], value: str, status: str) -> DataFrame:
    """G-11: values added up per member; the alphabetically first status is kept."""
    return df.groupBy(*keys).agg(F.sum(value).cast("bigint").alias(value), F.min(status).alias(status))


def comparable_members(df: DataFrame, member: str, period: str, periods: int, changed: DataFrame | None = None,
                       name: str = "is_geography_comparable") -> DataFrame:
    """G-12: a member present in every period, not technical and not on the change list."""
    present = (df.filter(~F.col(member).isin(UNKNOWN, EXCLUDED)).groupBy(member)
               .agg(F.count_distinct(period).alias("_p")).filter(F.col("_p") == periods).select(member))
    if changed is not None:
        present = present.join(changed.select(member).distinct(), member, "left_anti")
    return df.join(present.withColumn(name, F.lit(True)), member, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def availability_grid(df: DataFrame, period: str, source: str, sources: Sequence[str]) -> DataFrame:
    """G-13: every period with every source, and whether there is data."""
    seen = df.select(period, source).distinct().withColumn("has_data", F.lit(True))
    grid = df.select(period).distinct().withColumn(source, F.explode(F.array(*[F.lit(s) for s in sources])))
    return grid.join(seen, [period, source], "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))
