"""Matching records to a reference list by code and by tiered names (I-3 to I-11, I-13 to I-17)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.operators.scale import position_in_order, running_sum
from placegrid.session import materialize

# Which source key meets which reference key, and the tier of that meeting.
NAME_LADDER = (
    ("exact", "k_exact", "k_exact", 1), ("exact", "k_exact", "ok_exact", 2),
    ("folded", "k_folded", "k_folded", 3), ("folded", "k_folded", "ok_folded", 4),
    ("bracketless", "k_bracketless", "k_bracketless", 5), ("wordless", "k_wordless", "k_wordless", 6),
)
# The method a tier is reported as.
TIER_METHODS = {1: "name_exact", 2: "name_old", 3: "name_normalized", 4: "name_old", 5: "name_normalized", 6: "name_normalized"}


def key_rows(df: DataFrame, keep: Sequence[str], keys: Sequence[tuple[str, str, int]]) -> DataFrame:
    """One row per (kind, key, tier); NULL and empty keys dropped."""
    packs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(col).alias("key"), F.lit(tier).alias("tier"))
                      for kind, col, tier in keys])
    return (df.select(*keep, F.explode(packs).alias("_k")).select(*keep, "_k.kind", "_k.key", "_k.tier")
            .filter(F.col("key").isNotNull() & (F.col("key") != "")))


def reference_keys(units: DataFrame, code: str, scope: Sequence[str], ladder=NAME_LADDER) -> DataFrame:
    """The reference side, reduced to one row per (scope, kind, key, tier): how many codes, and the least.

    A name shared by very many units stays one row, so the join with the records is always many-to-one.
    """
    present = [(kind, col, tier) for kind, _, col, tier in ladder if col in units.columns]
    return (key_rows(units, [*scope, code], present).groupBy(*scope, "kind", "key", "tier")
            .agg(F.count_distinct(code).alias("hits"), F.min(code).alias("code")))


def resolve(records: DataFrame, record_key: Sequence[str], reference: DataFrame, scope: Sequence[str] = (),
            rank: str | None = None, ladder=NAME_LADDER) -> DataFrame:
    """I-3/I-4: best tier per record; one code there is a match, several are ambiguous, none is unmatched.

    ``records`` holds one row per record and scope (see ``with_scopes``); ``rank`` orders the scopes, and a better
    scope wins over a better tier. Scopes of one rank must not share units: their hits are added up. Adds
    ``rank, tier, hits, code, match_status, match_method``.
    """
    kinds = {}
    for kind, col, _, _ in ladder:
        kinds.setdefault(kind, col)
    extra = [rank] if rank else []
    source = key_rows(records, [*record_key, *scope, *extra], [(k, c, 0) for k, c in kinds.items()]).drop("tier")
    met = source.join(reference, [*scope, "kind", "key"]).withColumn("_rank", F.col(rank) if rank else F.lit(0))
    per_tier = met.groupBy(*record_key, "_rank", "tier").agg(
        F.sum("hits").cast("bigint").alias("hits"), F.min("code").alias("code"))
    best = per_tier.groupBy(*record_key).agg(F.min(F.struct(F.col("_rank").alias("rank"), "tier", "hits", "code")).alias("_b"))
    keys = records.select(*record_key).distinct()
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in record_key]
    out = keys.alias("l").join(best.alias("r"), same, "left").select("l.*", "r._b.*")
    methods = F.create_map(*[F.lit(x) for item in TIER_METHODS.items() for x in item])
    return (out.withColumn("match_status", F.when(F.col("hits") == 1, "matched").when(F.col("hits") > 1, "ambiguous")
                           .otherwise("unmatched"))
            .withColumn("code", F.when(F.col("hits") == 1, F.col("code")))
            .withColumn("match_method", F.when(F.col("hits") == 1, F.try_element_at(methods, "tier"))))


def parents_at_best_tier(records: DataFrame, record_key: Sequence[str], parents: DataFrame, code: str, scope: Sequence[str] = (),
                         ladder=NAME_LADDER[:4]) -> DataFrame:
    """I-5: every parent a record's parent name may mean, at its best tier (a parent that was split has two)."""
    kinds = {kind: col for kind, col, _, _ in ladder}
    offered = key_rows(parents, [*scope, code], [(kind, col, tier) for kind, _, col, tier in ladder if col in parents.columns])
    asked = key_rows(records, [*record_key, *scope], [(k, c, 0) for k, c in kinds.items()]).drop("tier")
    met = asked.join(offered, [*scope, "kind", "key"]).groupBy(*record_key, code).agg(F.min("tier").alias("tier"))
    best = met.groupBy(*record_key).agg(F.min("tier").alias("tier"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in record_key] + [F.col("l.tier") == F.col("r.tier")]
    return met.alias("l").join(best.alias("r"), same).select("l.*")


def with_scopes(records: DataFrame, scopes: Sequence[tuple[int, Column]], scope: str = "scope",
                rank: str = "scope_rank") -> DataFrame:
    """I-4: one row per scope a record may be searched in, best rank first; NULL scopes are left out."""
    packs = F.array(*[F.struct(F.lit(r).alias(rank), s.alias(scope)) for r, s in scopes])
    return records.withColumn("_s", F.explode(packs)).select(*records.columns, f"_s.{rank}", f"_s.{scope}").filter(
        F.col(scope).isNotNull())


def first_code_rule(records: DataFrame, record_key: Sequence[str], units: DataFrame, code: str,
                    rules: Sequence[tuple[str, Column, str]], names_agree: Column | None = None,
                    name_columns: Sequence[str] = (), same_names: Sequence[str] = ()) -> DataFrame:
    """I-6/I-7: ordered code rules ``(method, record expression, unit column)``; the first that names a unit wins.

    ``names_agree`` may read ``l.*`` (the record's ``name_columns``) and ``u.*`` (unit); a rule whose names disagree
    does not count. Where names agree if they are equal, ``same_names`` lists them instead: records and units then meet
    on code and names, and no pair is made of a code that many carry. Each distinct (code, names) is looked up once, whatever the number of records that carry it, and
    without names the units are reduced to one row per code first. Adds ``rule, hits, code, any_code`` (the first
    code named, agreeing or not).
    """
    names = list(dict.fromkeys([*name_columns, *same_names]))
    wanted = F.array(*[F.struct(F.lit(i + 1).alias("rule"), F.lit(col).alias("via"), expr.alias("wanted"))
                       for i, (_, expr, col) in enumerate(rules)])
    asked = (records.withColumn("_w", F.explode(wanted)).select(*dict.fromkeys([*record_key, *names]), "_w.*")
             .filter(F.col("wanted").isNotNull()))
    lookup = ["rule", "via", "wanted", *names]
    distinct = asked.select(*lookup).distinct()
    vias = sorted({col for _, _, col in rules})
    offered = units.withColumn("_o", F.explode(F.array(*[
        F.struct(F.lit(v).alias("via"), F.col(v).alias("wanted")) for v in vias]))).select(
        *units.columns, "_o.*").filter(F.col("wanted").isNotNull())
    if same_names and names_agree is None:
        by_code = offered.groupBy("via", "wanted").agg(F.min(code).alias("any_code"))
        by_name = offered.groupBy("via", "wanted", *same_names).agg(F.count_distinct(code).alias("hits"), F.min(code).alias("code"))
        found = (distinct.join(by_code, ["via", "wanted"]).join(by_name, ["via", "wanted", *same_names], "left")
                 .select(*lookup, F.coalesce("hits", F.lit(0)).alias("hits"), "code", "any_code"))
    elif names_agree is None:
        per_code = offered.groupBy("via", "wanted").agg(F.count_distinct(code).alias("hits"), F.min(code).alias("_code"))
        found = distinct.join(per_code, ["via", "wanted"]).select(
            *lookup, "hits", F.col("_code").alias("code"), F.col("_code").alias("any_code"))
    else:
        agree = F.coalesce(names_agree, F.lit(False))
        met = (distinct.alias("l").join(offered.alias("u"), (F.col("l.via") == F.col("u.via")) & (F.col("l.wanted") == F.col("u.wanted")))
               .select(*[F.col(f"l.{k}").alias(k) for k in lookup], F.col(f"u.{code}").alias("code"), agree.alias("agrees")))
        found = met.groupBy(*lookup).agg(
            F.count_distinct(F.when(F.col("agrees"), F.col("code"))).alias("hits"),
            F.min(F.when(F.col("agrees"), F.col("code"))).alias("code"), F.min("code").alias("any_code"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in lookup]
    per_rule = asked.alias("l").join(found.alias("r"), same).select(
        *[F.col(f"l.{k}").alias(k) for k in record_key], "l.rule", "r.hits", "r.code", "r.any_code")
    best = per_rule.groupBy(*record_key).agg(
        F.min(F.when(F.col("hits") > 0, F.struct("rule", "hits", "code"))).alias("_b"),
        F.min_by("any_code", "rule").alias("any_code"))
    return best.select(*record_key, "_b.*", "any_code")


def prefix_match(records: DataFrame, record_key: Sequence[str], name: str, units: DataFrame, unit_name: str, code: str,
                 parent: str) -> DataFrame:
    """I-8: a cut-off name of any length equals the first characters of a unit's name inside the same parent.

    Units and cut names are put in one order of (parent, name). The units that begin with a cut name lie between the
    name itself and the name with the last character behind it, so counting units up to both places gives the hits, and
    the only hit is the unit that was counted last. No prefixes are made, and no pairs. ``code`` is unique in a parent.
    """
    listed = units.where(F.col(unit_name).isNotNull()).select(F.col(parent).alias("_parent"), F.col(unit_name).alias("_name"), F.col(code).alias("_code")).distinct()
    asked = records.where(F.col(name).isNotNull() & F.col(parent).isNotNull())
    cut = asked.select(F.col(parent).alias("_parent"), F.col(name).alias("_cut")).distinct()
    ends = F.array(F.struct(F.lit(0).alias("_kind"), F.col("_cut").alias("_name")), F.struct(F.lit(2).alias("_kind"), F.concat("_cut", F.lit(chr(0x10FFFF))).alias("_name")))
    rows = listed.withColumn("_kind", F.lit(1)).unionByName(cut.select("_parent", "_cut", F.inline(ends)), allowMissingColumns=True)
    placed = position_in_order(rows, [F.col(c).asc_nulls_first() for c in ("_parent", "_name", "_kind", "_code", "_cut")], "_at")
    counted = materialize(running_sum(placed, [], "_at", {"_units": (F.col("_kind") == 1).cast("bigint")}))
    before = F.max(F.when(F.col("_kind") == 0, F.col("_units")))
    found = (counted.where("_kind <> 1").groupBy("_parent", "_cut").agg(F.max("_units").alias("_units"), before.alias("_before"))
             .select("_parent", "_cut", "_units", (F.col("_units") - F.col("_before")).alias("hits")).where("hits > 0"))
    only = counted.where("_kind = 1").select("_units", F.col("_code").alias("code"))
    single = found.where("hits = 1").join(only, "_units").select("_parent", "_cut", "hits", "code")
    found = single.unionByName(found.where("hits > 1").select("_parent", "_cut", "hits", F.lit(None).cast(units.schema[code].dataType).alias("code")))
    return (asked.join(found, (F.col(parent) == F.col("_parent")) & (F.col(name) == F.col("_cut"))).select(*record_key, "hits", "code"))


def apply_reviewed(matched: DataFrame, reviewed: DataFrame, key: Sequence[str], code: str = "code") -> DataFrame:
    """I-9: reviewed decisions (key, ``reviewed_code``, ``reason``) win over every rule.

    A reviewed row with a NULL code is a decision too: the record stays unmatched on purpose.
    """
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    joined = matched.alias("l").join(reviewed.withColumn("_seen", F.lit(True)).alias("r"), same, "left")
    seen = F.coalesce(F.col("r._seen"), F.lit(False))
    others = [f"l.{c}" for c in matched.columns if c not in (code, "match_status", "match_method")]
    return joined.select(
        *others,
        F.when(seen, F.col("r.reviewed_code")).otherwise(F.col(f"l.{code}")).alias(code),
        F.when(seen & F.col("r.reviewed_code").isNull(), "unmatched").when(seen, "matched")
        .otherwise(F.col("l.match_status")).alias("match_status"),
        F.when(seen, "reviewed_alias").otherwise(F.col("l.match_method")).alias("match_method"),
        F.when(seen, "reviewed").when(F.col("l.match_status") == "matched", "rule").otherwise("pending").alias("review_status"),
        F.col("r.reason").alias("reviewed_reason"))


def arbitrate(df: DataFrame, by_code: str, by_name: str, supported: Column, excluded: Column) -> DataFrame:
    """I-10: one decision from two pieces of evidence, with its method and reason.

    Where both exist and differ, the code wins only when the lower level supports it; otherwise the record is
    ambiguous.
    """
    code, name = F.col(by_code), F.col(by_name)
    cases = [
        (excluded, F.lit(None).cast("string"), "excluded", None, "excluded by rule"),
        (code == name, code, "matched", "code", "code and name agree"),
        (code.isNotNull() & name.isNotNull() & supported, code, "matched", "code_name_differs", "code, supported by the lower level"),
        (code.isNotNull() & name.isNotNull(), F.lit(None).cast("string"), "ambiguous", None, "code and name differ"),
        (code.isNotNull(), code, "matched", "code", "code only"),
        (name.isNotNull(), name, "matched", "name", "name only"),
    ]
    picks = {"decided_code": 1, "match_status": 2, "match_method": 3, "reason": 4}
    last = {"decided_code": None, "match_status": "unmatched", "match_method": None, "reason": "no code or name match"}
    columns = {}
    for out, at in picks.items():
        expr = None
        for case in cases:
            value = case[at] if isinstance(case[at], Column) else F.lit(case[at]).cast("string")
            when = F.coalesce(case[0], F.lit(False))
            expr = F.when(when, value) if expr is None else expr.when(when, value)
        columns[out] = expr.otherwise(F.lit(last[out]).cast("string"))
    return df.withColumns(columns)


def to_two_levels(df: DataFrame, keep: Sequence[str], city: str, sub_unit: str) -> DataFrame:
    """I-11: one decision written out as a city row and a sub-unit row."""
    return df.select(*keep, F.explode(F.array(
        F.struct(F.lit("city_mun").alias("geographic_level"), F.col(city).alias("code")),
        F.struct(F.lit("sub_unit").alias("geographic_level"), F.col(sub_unit).alias("code")))).alias("_x")).select(
        *keep, "_x.*")


def unmatched_by_design(df: DataFrame, rows: Column, target: str, reason: str) -> DataFrame:
    """I-13: rows that are not expected to match stay visible, with a NULL target and the reason."""
    return df.filter(rows).withColumns({target: F.lit(None).cast("string"), "match_status": F.lit("unmatched"),
                                        "reason": F.lit(reason)})


def match_distinct(df: DataFrame, keys: Sequence[str], matcher) -> DataFrame:
    """I-14: match each distinct name once and give the result to every row that carries it."""
    results = matcher(df.select(*keys).distinct())
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    added = [c for c in results.columns if c not in keys]
    return df.alias("l").join(results.alias("r"), same, "left").select("l.*", *[f"r.{c}" for c in added])


def majority_vote(df: DataFrame, subject: str, choice: str, at_least: int = 2) -> DataFrame:
    """I-15: the choice holding over half of a subject's rows, at least two of them, no tie; else NULL."""
    votes = df.groupBy(subject, choice).agg(F.count("*").alias("votes"))
    tally = votes.groupBy(subject).agg(
        F.sum("votes").alias("total"), F.max(F.struct("votes", choice)).alias("_top"))
    wins = (F.col("_top.votes") >= at_least) & (2 * F.col("_top.votes") > F.col("total"))
    return tally.select(subject, F.when(wins, F.col(f"_top.{choice}")).alias(choice),
                        F.col("_top.votes").alias("votes"), "total")


def by_elimination(open_records: DataFrame, candidates: DataFrame, claimed: DataFrame, group: Sequence[str],
                   code: str) -> DataFrame:
    """I-16: a record takes the one candidate of its group that nobody claimed."""
    free = (candidates.join(claimed.select(code).distinct(), code, "left_anti").groupBy(*group)
            .agg(F.count_distinct(code).alias("free"), F.min(code).alias(code)))
    waiting = open_records.groupBy(*group).agg(F.count("*").alias("waiting"))
    single = free.join(waiting, list(group)).filter((F.col("free") == 1) & (F.col("waiting") == 1))
    return open_records.join(single.select(*group, code), list(group), "left")


def match_rates(df: DataFrame, by: Sequence[str], status: str = "match_status") -> DataFrame:
    """I-17: rows and percent per status within ``by``."""
    counts = df.groupBy(*by, status).agg(F.count("*").alias("rows"))
    totals = counts.groupBy(*by).agg(F.sum("rows").alias("_total"))
    out = counts.join(totals, list(by)) if by else counts.withColumn("_total", counts.agg(F.sum("rows")).scalar())
    return out.withColumn("percent", 100.0 * F.col("rows").cast("double") / F.col("_total")).drop("_total")
