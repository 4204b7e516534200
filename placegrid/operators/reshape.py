"""Banners, sections and wide tables made long (C-30 to C-33)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.operators.scale import BLOCK_ROWS, carry_forward, running_sum


def carry_banner(df: DataFrame, by: Sequence[str], pos: str, is_banner: Column, label: str, name: str,
                 block: int = BLOCK_ROWS) -> DataFrame:
    """C-30: every row takes the label of the banner above it, within ``by`` only."""
    return carry_forward(df, by, pos, F.when(is_banner, F.col(label)), name, block)


def number_sections(df: DataFrame, by: Sequence[str], pos: str, starts: Column, name: str = "section",
                    block: int = BLOCK_ROWS) -> DataFrame:
    """C-31: how many section heads came so far; 0 before the first."""
    return running_sum(df, by, pos, {name: starts.cast("int")}, block)


def sections_with_head(df: DataFrame, by: Sequence[str], pos: str, starts: Column, carry: Mapping[str, str],
                       block: int = BLOCK_ROWS) -> DataFrame:
    """C-31: number the sections and give every row columns of its section head (``{new: column}``)."""
    numbered = number_sections(df, by, pos, starts, "section", block)
    heads = numbered.filter(starts).select(*by, "section", *[F.col(c).alias(n) for n, c in carry.items()])
    return numbered.join(heads, [*by, "section"], "left")


def periods_to_rows(df: DataFrame, keep: Sequence[str], period: str, measures: Mapping[str, Mapping[str, str]],
                    covered: Column | None = None) -> DataFrame:
    """C-32: one row per period from ``{period: {measure: column}}``; only periods in ``covered`` (comma list)."""
    names = list(next(iter(measures.values())))
    packs = F.array(*[
        F.struct(F.lit(p).alias(period), *[F.col(cols[m]).alias(m) for m in names]) for p, cols in measures.items()])
    if covered is not None:
        packs = F.filter(packs, lambda x: F.array_contains(F.split(covered, ","), x[period]))
    return df.select(*keep, F.explode(packs).alias("_p")).select(*keep, f"_p.{period}", *[f"_p.{m}" for m in names])


def cells_to_rows(df: DataFrame, keep: Sequence[str], cells: Mapping[tuple, str], dims: Sequence[str],
                  value: str) -> DataFrame:
    """C-33: one row per cell from ``{(dimension values): column}``."""
    packs = F.array(*[
        F.struct(*[F.lit(v).alias(d) for d, v in zip(dims, at)], F.col(c).alias(value)) for at, c in cells.items()])
    return df.select(*keep, F.explode(packs).alias("_c")).select(*keep, *[f"_c.{d}" for d in dims], f"_c.{value}")


def layouts_to_rows(df: DataFrame, keep: Sequence[str], layout: str,
                    layouts: Mapping[str, tuple[Column, Mapping[tuple, str]]], dims: Sequence[str], value: str) -> DataFrame:
    """C-33: several layouts in one table; ``{layout: (row filter, cells)}``, one scan for all of them."""
    empty = None
    for version, (rows, cells) in layouts.items():
        packs = F.array(*[
            F.struct(*[F.lit(v).alias(d) for d, v in zip(dims, at)], F.col(c).alias(value)) for at, c in cells.items()])
        chosen = F.when((F.col(layout) == version) & rows, packs)
        empty = chosen if empty is None else F.coalesce(empty, chosen)
    return (df.select(*keep, F.explode(empty).alias("_c"))
            .select(*keep, *[f"_c.{d}" for d in dims], f"_c.{value}"))
