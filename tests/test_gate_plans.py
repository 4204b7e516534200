"""Each layer's gate passes on good rows and names the rule a changed row breaks."""

import datetime

from pyspark.sql import functions as F

from helpers import statuses
from placegrid.plans import gates as plan


def failed(checks):
    return {n for n, s in statuses(checks).items() if s == "FAIL"}


def test_layer_gates(table):
    at = datetime.datetime(2024, 1, 1)
    source = table([(i,) for i in range(300)], "source_row_number int")
    clean = table([(f"{i:06d}", "A", "a", "b1", "h", i, "run-1", at) for i in range(299)],
                  "id string, pub string, std string, batch_id string, source_sha256 string, source_row_number int, run_id string, cleaned_at_utc timestamp")
    quarantine = table([("x", ["id_malformed"])], "id string, quarantine_reasons array<string>")
    gate = lambda c: plan.silver_gate(source, c, quarantine, ["id"], "run-1", ["id_malformed"], rules={"id_valid": F.col("id").rlike("^[0-9]{6}$")}, labels={"pub": ("pub", "std")})
    assert failed(gate(clean)) == set() and statuses(gate(clean))["quarantine_rate"] == "WARN"
    broken = clean.withColumn("std", F.when(F.col("id") != "000001", F.col("std"))).withColumn("id", F.when(F.col("id") == "000002", "000003").otherwise(F.col("id")))
    assert failed(gate(broken)) == {"pub_mapped", "key_unique"}
    assert failed(gate(clean.limit(298))) == {"rows_reconcile"}
    batches = lambda *r: table(list(r), "batch_id string, source_sha256 string, status string, source_rows int, expected_rows int")
    assert failed(plan.bronze_gate(clean, batches(("b1", "h", "succeeded", 299, 299), ("b0", "g", "failed", 5, 5)))) == set()
    assert failed(plan.bronze_gate(clean.union(clean.limit(1)), batches(("b2", "h", "succeeded", 299, 299)))) == {
        "no_pipeline_duplicates_unique", "rows_have_a_known_batch", "succeeded_batches_reconcile"}
    assert failed(plan.bronze_gate(clean, batches(("b1", "h", "succeeded", 299, 300)))) == {"succeeded_batches_reconcile"}


def test_map_and_model_gates(table):
    units = table([("U1",), ("U2",)], "psgc_code string")
    mapped = table([(1, "U1", "matched"), (2, None, "unmatched"), (3, "U2", "matched")], "id int, psgc_code string, match_status string")
    assert failed(plan.map_gate(mapped, mapped, ["id"], units, unique_target=True)) == set()
    odd = table([(1, "U1", "matched"), (2, "U1", "matched"), (3, "U9", "unmatched")], "id int, psgc_code string, match_status string")
    assert failed(plan.map_gate(mapped, odd, ["id"], units, unique_target=True)) == {"code_only_when_matched", "code_resolves", "target_taken_once"}
    places = table([("C1",), ("UNKNOWN",), ("EXCLUDED",)], "place_code string")
    assert failed(plan.dimension_gate(places, "place_code")) == set()
    assert failed(plan.dimension_gate(places.filter("place_code <> 'EXCLUDED'"), "place_code")) == {"member_excluded"}
    schema = "entity_id string, period string, level_code string, place_code string, match_status string, is_offered boolean, null_cells int, published_cell_sum bigint, learner_count bigint"
    good = [("1", "p", "ES", "C1", "matched", True, 0, 5, 5), ("1", "p", "JHS", "C1", "matched", False, 2, 0, 0), ("2", "p", "ES", "UNKNOWN", "unmatched", True, 1, 5, None)]
    gate = lambda rows: plan.fact_gate(table(rows, schema), ["entity_id", "period", "level_code"], {"place_code": (places, "place_code")}, plan.enrollment_rules(),
                                       recomputed=table(good, schema), values=["learner_count"])
    assert failed(gate(good)) == set()
    assert failed(gate([good[0][:8] + (6,), *good[1:]])) == {"complete_is_cell_sum", "learner_count_matches"}
    assert failed(gate([good[0][:3] + ("C9",) + good[0][4:], *good[1:]])) == {"place_code_resolves"}
