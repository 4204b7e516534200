"""The check list of each layer's gate, put together from the gate operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.operators import gates
from placegrid.rules import EXCLUDED, UNKNOWN

STATUSES = ("matched", "ambiguous", "unmatched", "excluded")


def bronze_gate(rows: DataFrame, batches: DataFrame, identity: Sequence[str] = ("source_sha256", "source_row_number")) -> DataFrame:
    """No row twice, every row of a known batch, every succeeded batch with the rows of its file."""
    return gates.all_checks(gates.key_checks(rows, identity, "no_pipeline_duplicates"),
                            gates.foreign_key(rows, "batch_id", batches, "batch_id", "rows_have_a_known_batch"), gates.batches_reconcile(rows, batches))


def silver_gate(source: DataFrame, clean: DataFrame, quarantine: DataFrame, key: Sequence[str], run_id: str, reasons: Sequence[str],
                lineage: Sequence[str] = ("batch_id", "source_sha256", "source_row_number"), rules: Mapping[str, Column] | None = None,
                counters: Mapping[str, Column] | None = None, labels: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Rows reconcile, key unique, lineage complete, row rules, label maps, quarantine rate and reasons.

    ``rules`` must hold on every clean row, ``counters`` are recorded only, ``labels`` pairs a published with its
    standard column (``{check: (published, standard)}``).
    """
    checks = [gates.rule_holds(name, rule) for name, rule in (rules or {}).items()]
    checks += [gates.counter(f"rule/{name}", hit) for name, hit in (counters or {}).items()]
    checks += [gates.zero(f"{name}_mapped", F.col(pub).isNotNull() & (F.col(pub) != "") & F.col(std).isNull()) for name, (pub, std) in (labels or {}).items()]
    classified = clean.select(F.array().cast("array<string>").alias("reasons")).unionByName(quarantine.select(F.col("quarantine_reasons").alias("reasons")))
    parts = [gates.rows_reconcile("rows_reconcile", clean, quarantine, whole=source), gates.key_checks(clean, key),
             gates.lineage_checks(clean, lineage, run_id), gates.quarantine_rate(classified, "reasons", reasons)]
    return gates.all_checks(*parts, gates.run_checks(clean, checks)) if checks else gates.all_checks(*parts)


def map_gate(source: DataFrame, mapped: DataFrame, key: Sequence[str], units: DataFrame, code: str = "psgc_code", by: Sequence[str] = (),
             floor: float = 99.0, unique_target: bool = False) -> DataFrame:
    """One row per record, known statuses, a code exactly when matched, codes resolve, match rate above the floor."""
    matched = F.col("match_status") == "matched"
    parts = [gates.rows_reconcile("one_row_per_record", mapped, whole=source), gates.key_checks(mapped, key),
             gates.run_checks(mapped, [gates.rule_holds("match_status_known", F.col("match_status").isin(*STATUSES)),
                                       gates.rule_holds("code_only_when_matched", matched == F.col(code).isNotNull())]),
             gates.foreign_key(mapped, code, units, code, "code_resolves", nulls_allowed=True)]
    if by:
        parts.append(gates.match_rate_checks(mapped, by, floor))
    if unique_target:
        parts.append(gates.one_to_one(mapped.filter(matched), code))
    return gates.all_checks(*parts)


def dimension_gate(members: DataFrame, key: str, technical: Sequence[str] = (UNKNOWN, EXCLUDED), parents: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Key unique, the technical members present once each, parents resolve (``{column: (table, key)}``)."""
    parts = [gates.key_checks(members, [key])]
    parts.append(gates.run_checks(members, [gates.equals(f"member_{t.lower()}", F.count_if(F.col(key) == t), 1) for t in technical]))
    parts += [gates.foreign_key(members, column, table, k, f"{column}_resolves", nulls_allowed=True) for column, (table, k) in (parents or {}).items()]
    return gates.all_checks(*parts)


def fact_gate(fact: DataFrame, grain: Sequence[str], foreign: Mapping[str, tuple[DataFrame, str]], rules: Mapping[str, Column] | None = None,
              recomputed: DataFrame | None = None, values: Sequence[str] = (), totals: tuple[DataFrame, Sequence[str], str] | None = None) -> DataFrame:
    """Grain unique, foreign keys resolve, rules hold, an independent recomputation agrees, group totals reconcile."""
    parts = [gates.key_checks(fact, grain, "grain")]
    parts += [gates.foreign_key(fact, column, table, k, f"{column}_resolves", nulls_allowed=True) for column, (table, k) in foreign.items()]
    if rules:
        parts.append(gates.run_checks(fact, [gates.rule_holds(n, r) for n, r in rules.items()]))
    if recomputed is not None:
        parts.append(gates.compare_rows(fact, recomputed, grain, values))
    if totals is not None:
        source, by, value = totals
        parts.append(gates.totals_reconcile(fact, source, by, value, f"{value}_reconciles"))
    return gates.all_checks(*parts)


def enrollment_rules() -> dict[str, Column]:
    """The rules of the enrollment fact: counts follow the flag and the cells, statuses follow the keys."""
    offered, n, place = F.col("is_offered"), F.col("learner_count"), F.col("place_code")
    return {
        "not_offered_is_zero": offered.isNull() | offered | n.eqNullSafe(F.lit(0).cast("bigint")),
        "missing_cell_is_missing": ~F.coalesce(offered, F.lit(False)) | ((F.col("null_cells") > 0) == n.isNull()),
        "complete_is_cell_sum": n.isNull() | ~F.coalesce(offered, F.lit(False)) | (n == F.col("published_cell_sum")),
        "technical_member_follows_status": (F.col("match_status") == "matched") == ~place.isin(UNKNOWN, EXCLUDED),
        "count_not_negative": n.isNull() | (n >= 0)}
