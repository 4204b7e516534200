"""Running values and ranks that never gather a whole group in one task.

Spark evaluates a window by sending every row of its partition key to one task. That is fine for keys with few
rows, and wrong for a key that may hold a third of the table. The functions here split a group by position or by
value first, work inside the pieces, and combine small per-piece summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from placegrid.session import materialize

BLOCK_ROWS = 100_000
# about what one task may order on its own
ONE_TASK_ROWS = 500_000


def _blocks(by: list[str], pos: str, block: int) -> tuple[Column, Column]:
    """The block of a position and the group of ``block`` blocks that it lies in."""
    at = F.floor(F.col(pos) / block)
    return at, F.floor(at / block)


def running_sum(df: DataFrame, by: Sequence[str], pos: str, sums: dict[str, Column | str],
                block: int = BLOCK_ROWS) -> DataFrame:
    """Adds inclusive running sums by ``pos`` within ``by``: ``{new_column: value}``.

    ``pos`` is a whole number that grows with the order (a row number). Rows are windowed inside blocks of
    ``block`` positions, the block totals inside groups of ``block`` blocks, and the totals of these groups last: no
    window holds more than ``block`` rows, or one row for each ``block * block`` positions.
    """
    by = list(by)
    values = {name: (F.col(v) if isinstance(v, str) else v) for name, v in sums.items()}
    at, top = _blocks(by, pos, block)
    rows = df.withColumn("_block", at).withColumn("_top", top)
    earlier = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda name, keys, order: F.coalesce(F.sum(name).over(earlier(keys, order)), F.lit(0))
    totals = rows.groupBy(*by, "_top", "_block").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    tops = totals.groupBy(*by, "_top").agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in values])
    tops = tops.select(*[F.col(c).alias(f"_u_{c}") for c in [*by, "_top"]], *[so_far(f"_t_{n}", by, "_top").alias(f"_p_{n}") for n in values])
    offsets = totals.withColumns({f"_o_{n}": so_far(f"_t_{n}", [*by, "_top"], "_block") for n in values})
    offsets = offsets.join(tops, [F.col(c).eqNullSafe(F.col(f"_u_{c}")) for c in [*by, "_top"]]).select(
        *[F.col(c).alias(f"_k_{c}") for c in [*by, "_block"]], *[(F.col(f"_o_{n}") + F.col(f"_p_{n}")).alias(f"_o_{n}") for n in values])
    inside = Window.partitionBy(*by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    joined = local.join(offsets, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_block"]], "left")
    return (joined.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in values})
            .drop("_block", "_top", *[f"_k_{c}" for c in [*by, "_block"]], *[f"_o_{n}" for n in values]))


def carry_forward(df: DataFrame, by: Sequence[str], pos: str, value: Column | str, name: str,
                  block: int = BLOCK_ROWS) -> DataFrame:
    """Adds the last non-null ``value`` at or before each row, in ``pos`` order within ``by`` (C-30).

    In blocks, groups of blocks and the whole, like ``running_sum``.
    """
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    at, top = _blocks(by, pos, block)
    rows = df.withColumn("_block", at).withColumn("_top", top).withColumn("_value", value)
    last = lambda column, keys, order: F.last(column, ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    # a value may be a structure of NULLs, so blocks without one are told apart by the position
    held = F.max(F.when(F.col("_value").isNotNull(), F.struct(F.col(pos).alias("_at"), F.col("_value"))))
    tails = rows.groupBy(*by, "_top", "_block").agg(held.alias("_tail"))
    tops = tails.groupBy(*by, "_top").agg(F.max("_tail").alias("_tail"))
    tops = tops.select(*[F.col(c).alias(f"_u_{c}") for c in [*by, "_top"]], last("_tail", by, "_top").alias("_before"))
    offsets = tails.withColumn("_carried", last("_tail", [*by, "_top"], "_block"))
    offsets = offsets.join(tops, [F.col(c).eqNullSafe(F.col(f"_u_{c}")) for c in [*by, "_top"]]).select(
        *[F.col(c).alias(f"_k_{c}") for c in [*by, "_block"]], F.coalesce("_carried", "_before")["_value"].alias("_carried"))
    inside = Window.partitionBy(*by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    return (local.join(offsets, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_block"]], "left")
            .withColumn(name, F.coalesce("_local", "_carried"))
            .drop("_block", "_top", "_value", "_local", "_carried", *[f"_k_{c}" for c in [*by, "_block"]]))


def position_in_order(df: DataFrame, order: Sequence[Column], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds the 1-based position of each row in ``order``, over the whole table or within ``by``.

    The rows are range-partitioned on the order itself, into pieces of about ``ONE_TASK_ROWS``, and written with
    their piece number, so the pieces stay fixed; each piece is numbered on its own and shifted by the row counts of
    the pieces before it. ``order`` must be total.
    """
    by = list(by)
    rows = materialize(df)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    wanted = max(1, -(-rows.count() // ONE_TASK_ROWS))
    keys = [*[F.col(c).asc_nulls_first() for c in by], *order]
    pieces = materialize(rows.repartitionByRange(wanted, *keys).withColumn("_piece", F.spark_partition_id()))
    before = group.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.groupBy(*by, "_piece").count()
               .withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
               .select(*[F.col(c).alias(f"_k_{c}") for c in [*by, "_piece"]], "_shift"))
    local = pieces.withColumn("_local", F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_piece"]]
    return (local.join(offsets, same).withColumn(name, (F.col("_local") + F.col("_shift")))
            .drop("_piece", "_local", "_shift", *[f"_k_{c}" for c in [*by, "_piece"]]))


def tie_ranked_first(df: DataFrame, by: Sequence[str], latest: str) -> DataFrame:
    """Rows holding the highest ``latest`` of their key, ties kept (rank = 1), by aggregate and join."""
    top = df.groupBy(*by).agg(F.max(latest).alias("_top"))
    left, right = df.alias("l"), top.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    return left.join(right, [*same, F.col(f"l.{latest}") == F.col("r._top")]).select("l.*")
