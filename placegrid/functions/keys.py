"""Name keys for matching places (I-1, I-2)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.functions.text import _c, squeeze
from placegrid.rules import ACCENTED, PLAIN


def exact_key(col: Column | str) -> Column:
    """Upper case, status brackets dropped, 'CITY OF X' turned into 'X CITY'."""
    name = F.regexp_replace(squeeze(F.upper(_c(col))), " ?[(](CAPITAL|NOT A PROVINCE)[)]$", "")
    return F.when(name.startswith("CITY OF "), F.concat(F.substring(name, 9, 1000), F.lit(" CITY"))).otherwise(name)


def folded_key(exact: Column | str) -> Column:
    """Accents removed; full stops, hyphens and apostrophes become spaces."""
    return squeeze(F.translate(F.translate(_c(exact), ACCENTED, PLAIN), ".-'", "   "))


def bracketless_key(folded: Column | str) -> Column:
    """Anything in brackets dropped, even an unclosed one."""
    return squeeze(F.regexp_replace(_c(folded), "[(][^)]*[)]?", " "))


def wordless_key(bracketless: Column | str) -> Column:
    """The words CITY and OF ignored."""
    words = F.split(_c(bracketless), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("CITY", "OF", "")), " ")


def expanded_key(folded: Column | str, abbreviations: Mapping[str, str]) -> Column:
    """I-2: abbreviations written out, word by word."""
    table = F.create_map(*[F.lit(x) for item in abbreviations.items() for x in item])
    return F.array_join(F.transform(F.split(_c(folded), " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def letters_key(folded: Column | str) -> Column:
    """I-2: letters only."""
    return F.regexp_replace(_c(folded), "[^A-Z]", "")


def name_keys(df: DataFrame, col: str, prefix: str = "k_") -> DataFrame:
    """The whole ladder as columns ``<prefix>exact|folded|bracketless|wordless``, each built on the one before."""
    return (
        df.withColumn(f"{prefix}exact", exact_key(col))
        .withColumn(f"{prefix}folded", folded_key(f"{prefix}exact"))
        .withColumn(f"{prefix}bracketless", bracketless_key(f"{prefix}folded"))
        .withColumn(f"{prefix}wordless", wordless_key(f"{prefix}bracketless"))
    )
