"""Exact quantiles of groups of any size by a radix select over order-preserving 64-bit keys.

Equal values are counted together first. Then each round counts the next 16 bits of the keys, moves every wanted rank into
the slice that holds it, and goes on with that slice alone, so no task ever orders a group and nothing is estimated.
The rounds are the same at every size; their number follows from how far apart the smallest and largest key are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from placegrid.session import materialize

DIGIT = 16


def order_key(value: Column, kind: T.DataType) -> Column:
    """A whole number of 64 bits that is in the order of ``value``, and equal for equal values.

    Floating numbers give their IEEE bits, negated below zero; both zeros are one value, and NaN comes last.
    """
    if isinstance(kind, T.DecimalType):
        if kind.precision > 18:
            raise ValueError(f"decimals of up to 18 digits have a 64-bit key, not {kind.simpleString()}")
        return (value * F.lit(10 ** kind.scale).cast("decimal(19,0)")).cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = F.abs(value.cast("double"))
        guess = F.floor(F.log2(x))
        guess = F.when(x < F.pow(F.lit(2.0), guess), guess - 1).when(x >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
        fraction = ((x / F.pow(F.lit(2.0), guess) - 1) * F.lit(float(1 << 52))).cast("bigint")
        small = (x * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("bigint")  # below the normal numbers
        bits = (F.when(F.isnan(value), F.lit((2047 << 52) + 1)).when(x == float("inf"), F.lit(2047 << 52)).when(x == 0, F.lit(0))
                .when(x < 2.0 ** -1022, small).otherwise(F.shiftleft(guess + 1023, 52) + fraction))
        return F.when((value < 0) & ~F.isnan(value), -bits).otherwise(bits)
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    raise ValueError(f"quantiles are of numbers, not of {kind.simpleString()}")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row per group: ``n`` and each linearly interpolated quantile, exact for groups of any size.

    NULL values do not count, a NULL group is a group, and an empty ``by`` is one group of all rows. A table without
    values gives no rows.
    """
    by = list(by)
    group = [f"_g{k}" for k in range(len(by))]
    kind = df.schema[value].dataType
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, group)], F.col(value).alias("_v"))
    counted = materialize(rows.withColumn("_key", order_key(F.col("_v"), kind)).groupBy(*group, "_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_v")))
    low, high = counted.agg(F.min("_key"), F.max("_key")).first()
    low = 0 if low is None or high - low >= 1 << 63 else low
    bits = max(1, (high - low).bit_length()) if high is not None and low else 64
    rounds = -(-bits // DIGIT)
    counted = counted.withColumn("_key", F.col("_key") - F.lit(low))

    def met(left: DataFrame, right: DataFrame, *on: Column) -> DataFrame:
        """Inner join on the group, NULL being equal to NULL, and more; ``right`` has its group under names of its own."""
        return left.join(right, [*[F.col(g).eqNullSafe(F.col(f"_r{g}")) for g in group], *on]).drop(*[f"_r{g}" for g in group])

    renamed = lambda table: table.select(*[F.col(c).alias(f"_r{c}") if c in group else c for c in table.columns])
    part = lambda shift: F.lit(0).cast("bigint") if shift >= rounds * DIGIT else F.shiftright("_key", shift)
    totals = counted.groupBy(*group).agg(F.sum("_n").alias("n"))
    asked = F.array(*[F.struct(F.lit(k).alias("q"), (F.lit(p) * (F.col("n") - 1)).alias("h")) for k, p in enumerate(probabilities.values())])
    wanted = totals.withColumn("_w", F.explode(asked)).select(*group, "n", "_w.q", "_w.h", F.lit(0).cast("bigint").alias("_slice"))
    wanted = wanted.withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("h"), F.ceil("h"))))).withColumn("_rank", F.col("_at"))
    for shift in range((rounds - 1) * DIGIT, -1, -DIGIT):
        slices = renamed(wanted.select(*group, F.col("_slice").alias("_open")).distinct())
        inside = met(counted.withColumn("_part", part(shift + DIGIT)), slices, F.col("_part") == F.col("_open"))
        sizes = inside.groupBy(*group, "_part", part(shift).alias("_next")).agg(F.sum("_n").alias("_size"))
        # one row for each of the 65,536 digits at most
        up_to = Window.partitionBy(*group, "_part").orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        ends = renamed(sizes.withColumn("_end", F.sum("_size").over(up_to)))
        holds = (F.col("_slice") == F.col("_part")) & (F.col("_rank") >= F.col("_end") - F.col("_size")) & (F.col("_rank") < F.col("_end"))
        found = met(wanted, ends, holds)
        wanted = materialize(found.select(*group, "n", "q", "h", "_at", F.col("_next").alias("_slice"), (F.col("_rank") - (F.col("_end") - F.col("_size"))).alias("_rank")))
    picked = met(wanted, renamed(counted.select(*group, "_key", "_v")), F.col("_slice") == F.col("_key"))
    ends = [F.max(F.when((F.col("q") == k) & (F.col("_at") == side("h")), F.col("_v"))).alias(f"_{name}{k}")
            for k in range(len(probabilities)) for name, side in (("low", F.floor), ("high", F.ceil))]
    out = picked.groupBy(*group).agg(F.max("n").alias("n"), *ends).where(F.col("n").isNotNull())

    def between(k: int, p: float) -> Column:
        h = F.lit(p) * (F.col("n") - 1)
        return F.when(F.col(f"_low{k}") == F.col(f"_high{k}"), F.col(f"_low{k}")).otherwise(
            F.col(f"_low{k}") + (h - F.floor(h)) * (F.col(f"_high{k}") - F.col(f"_low{k}")))

    return out.select(*[F.col(g).alias(c) for c, g in zip(by, group)], "n", *[between(k, p).alias(name) for k, (name, p) in enumerate(probabilities.items())])
