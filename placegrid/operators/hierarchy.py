"""A place tree recovered from an ordered list of counts (C-35 to C-37)."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.operators.scale import BLOCK_ROWS, carry_forward, running_sum
from placegrid.session import materialize


def _nesting(places: DataFrame, spans: DataFrame, by: Sequence[str], pos: str, name: str, block: int) -> DataFrame:
    """Adds how many spans enclose each place: +1 after a span starts, -1 after it ends, summed in order.

    Spans nest, so this needs no range join.
    """
    opens = spans.select(*by, (F.col("start_pos") + 1).alias(pos), F.lit(1).alias("_d"))
    closes = spans.select(*by, (F.col("end_pos") + 1).alias(pos), F.lit(-1).alias("_d"))
    deltas = opens.unionByName(closes).groupBy(*by, pos).agg(F.sum("_d").alias("_delta"))
    joined = places.join(deltas, [*by, pos], "left")
    return running_sum(joined, by, pos, {name: F.coalesce("_delta", F.lit(0))}, block).drop("_delta")


def _hashes(values: list[Column]) -> list[Column]:
    """Two 64-bit keys of a row of sums."""
    return [F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)]


def spans_from_sums(places: DataFrame, by: Sequence[str], pos: str, measures: Sequence[str],
                    block: int = BLOCK_ROWS) -> DataFrame:
    """C-35: place i sums the places after it up to j when, in every measure, running(j) = running(i) + value(i).

    ``pos`` counts 1, 2, 3, ... within ``by``. A span ends before the last place whose sum of all places before it is
    the sum that the start has to reach. Both sums meet as two 64-bit keys and are compared after the join, so no
    pairs are produced. Places inside a found span count once, as their aggregate, and leave the table: a pass only
    reads what the passes before it left open. Ends when a pass finds nothing.
    """
    by = list(by)
    sums = [f"_r{k}" for k in range(len(measures))]
    values = [f"_v{k}" for k in range(len(measures))]
    complete = F.lit(True)
    for m in measures:
        complete = complete & F.col(m).isNotNull()
    rows = places.select(*by, pos, *[F.coalesce(F.col(m).cast("bigint"), F.lit(0)).alias(v) for m, v in zip(measures, values)], complete.alias("_may_start"))
    behind = places.groupBy(*by).agg((F.max(pos) + 1).alias(pos)).select(*by, pos, *[F.lit(0).cast("bigint").alias(v) for v in values], F.lit(False).alias("_may_start"))
    open_rows = materialize(rows.unionByName(behind))
    spans = None
    for number in itertools.count(1):
        state = running_sum(open_rows, by, pos, dict(zip(sums, values)), block)
        before = [(F.col(r) - F.col(v)) for r, v in zip(sums, values)]
        goal = [(F.col(r) + F.col(v)) for r, v in zip(sums, values)]
        first, second = _hashes(before)
        ends = state.groupBy(*by, first.alias("_h"), second.alias("_i")).agg(F.max(F.struct(F.col(pos).alias("p"), F.array(*before).alias("sums"))).alias("_last"))
        first, second = _hashes(goal)
        starts = state.where("_may_start").select(*by, F.col(pos).alias("start_pos"), first.alias("_h"), second.alias("_i"), F.array(*goal).alias("_goal"))
        found = materialize(starts.join(ends, [*by, "_h", "_i"]).where((F.col("_last.p") > F.col("start_pos") + 1) & (F.col("_last.sums") == F.col("_goal")))
                            .select(*by, "start_pos", (F.col("_last.p") - 1).alias("end_pos"), F.lit(number).alias("found_in_pass")))
        if found.isEmpty():
            return found if spans is None else spans
        spans = found if spans is None else spans.unionByName(found)
        # a place is covered by the spans that opened before it and did not close up to it; both ends are open places
        opens = found.select(*by, F.col("start_pos").alias(pos), F.lit(1).alias("_opens"), F.lit(0).alias("_closes"))
        closes = found.select(*by, (F.col("end_pos") + 1).alias(pos), F.lit(0).alias("_opens"), F.lit(1).alias("_closes"))
        turns = opens.unionByName(closes).groupBy(*by, pos).agg(F.sum("_opens").alias("_opens"), F.sum("_closes").alias("_closes"))
        turned = open_rows.join(turns, [*by, pos], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_opens", "_closes")})
        turned = running_sum(turned, by, pos, {"_cover": F.col("_opens") - F.col("_closes")}, block)
        open_rows = materialize(turned.where(F.col("_cover") - F.col("_opens") == 0).select(
            *by, pos, *values, (F.col("_may_start") & (F.col("_opens") == 0)).alias("_may_start")))


def close_spans(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """C-36: a span whose last place starts its own span ends where that one ends, until nothing moves any more.

    A chain of spans halves with every round, since the inner ends have moved too.
    """
    while True:
        inner = spans.select(*by, F.col("start_pos").alias("end_pos"), F.col("end_pos").alias("_inner_end"))
        moved = materialize(spans.join(inner, [*by, "end_pos"], "left")
                            .withColumn("_moves", F.coalesce(F.col("_inner_end") > F.col("end_pos"), F.lit(False)))
                            .withColumn("end_pos", F.greatest("end_pos", "_inner_end")).drop("_inner_end"))
        spans = moved.drop("_moves")
        if moved.filter("_moves").isEmpty():
            return spans


def tree_from_spans(places: DataFrame, spans: DataFrame, by: Sequence[str], pos: str, name: str,
                    block: int = BLOCK_ROWS) -> DataFrame:
    """C-37: depth, parent position, level and the names of the enclosing regions and provinces.

    What encloses a place at a depth is the last span start of that depth before it. So every place asks for the depth
    above its own, for region and for province, and one carry over (depth, position) answers all, however deep the tree.
    """
    by = list(by)
    starts = spans.select(*by, F.col("start_pos").alias(pos), F.lit(True).alias("is_aggregate")).distinct()
    tree = (_nesting(places, spans, by, pos, "depth", block).join(starts, [*by, pos], "left")
            .withColumn("is_aggregate", F.coalesce("is_aggregate", F.lit(False))))
    tree = materialize(tree)
    depth = F.col("depth").cast("bigint")
    asked = F.filter(F.array_distinct(F.array(depth - 1, F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))), lambda d: (d >= 0) & (d < depth))
    asks = tree.select(*by, pos, F.explode(asked).alias("_depth"), F.lit(None).cast(f"struct<p:{tree.schema[pos].dataType.simpleString()},n:string>").alias("_head"))
    heads = tree.where("is_aggregate").select(*by, pos, depth.alias("_depth"), F.struct(F.col(pos).alias("p"), F.col(name).alias("n")).alias("_head"))
    told = carry_forward(asks.unionByName(heads), [*by, "_depth"], pos, "_head", "_around", block).where(F.col("_head").isNull())
    around = told.groupBy(*by, pos).agg(
        F.max_by("_around", "_depth").alias("_parent"), F.max(F.when(F.col("_depth") == 1, F.col("_around.n"))).alias("_region"),
        F.max(F.when(F.col("_depth") == 2, F.col("_around.n"))).alias("_province"), F.max("_depth").alias("_deepest"))
    level = (F.when(F.col("is_aggregate") & (F.col("depth") == 0), "country")
             .when(F.col("is_aggregate") & (F.col("depth") == 1), "region")
             .when(F.col("is_aggregate") & (F.col("depth") == 2), "province")
             .when(~F.col("is_aggregate") & F.col("depth").isin(2, 3), "city_municipality"))
    # the region (or province) itself counts as its own
    itself = lambda d: F.when((F.col("depth") == d) & F.col("is_aggregate"), F.col(name))
    parent = F.when(F.col("_deepest") == depth - 1, F.col("_parent"))
    return (tree.join(around, [*by, pos], "left")
            .withColumns({"parent_pos": parent["p"], "parent_name": parent["n"], "level": level,
                          "region_name": F.coalesce(itself(1), "_region"), "province_name": F.coalesce(itself(2), "_province")})
            .drop("_parent", "_region", "_province", "_deepest"))
