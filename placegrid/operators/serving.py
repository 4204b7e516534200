"""Result sets planners read (D-1 to D-38): filters, rankings, shares and long series over the published tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.session import literal_table
from placegrid import rules
from placegrid.operators.metrics import entity_rollup, in_scope, ratio
from placegrid.operators.scale import position_in_order, tie_ranked_first

ALL = "(All)"
# Labels of the served columns.
SIGNALS = ("Signal present", "No signal", "Not assessed")
GROWTH = ("Growing", "Not growing", "Not comparable")
READINESS = ("Fully assessed", "Partly assessed", "Data review")
NO_PROVINCE = "Independent cities (no province)"
COVERAGE_BANDS = ("Assessed (90% or more)", "Incomplete (under 90%)", "Unavailable")
SHARE_BANDS = ("No school above the screen", "Under 10%", "10-25%", "25-50%", "50% or more")


def chosen(column: str, value: str | None) -> Column:
    """One filter of a page: '(All)' or a value."""
    return F.lit(True) if value in (None, ALL) else F.col(column) == value


def number(col: Column, places: int = 0, missing: str = "Not reported") -> Column:
    return F.coalesce(F.format_number(col, places), F.lit(missing))


def place_labels(places: DataFrame) -> DataFrame:
    """D-1: display labels; the short region name is what its brackets hold."""
    region, at = F.col("region_name"), F.instr("region_name", F.lit("("))
    short = F.when(at > 0, F.substring(region, at + 1, F.instr("region_name", F.lit(")")) - at - 1)).otherwise(region)
    return places.filter(F.col("member_type") == "regular").select(
        "place_code", "place_name", F.concat_ws(", ", "place_name", F.coalesce("province_name", "region_name")).alias("place_label"),
        F.coalesce("province_name", F.lit(NO_PROVINCE)).alias("province_label"), "region_name", short.alias("region_short"),
        F.when(F.lower("place_type") == "city", "City").otherwise("Municipality").alias("type_label"))


def overlay(base: DataFrame, scenarios: DataFrame, scenario: str, columns: Sequence[str], key: str = "place_code") -> DataFrame:
    """D-2: the chosen scenario's figures in place of the published ones."""
    other = scenarios.filter(F.col("scenario") == scenario).select(key, *columns)
    return base.drop(*columns).join(other, key)


def signal(flag: Column, assessed: Column) -> Column:
    return F.when(flag == 1, SIGNALS[0]).when(F.coalesce(assessed, F.lit(False)), SIGNALS[1]).otherwise(SIGNALS[2])


def evidence(matrix: DataFrame, places: DataFrame, screen: DataFrame, levels: DataFrame, level_codes: Sequence[str] = tuple(rules.TEACHER_REFERENCES)) -> DataFrame:
    """D-3: one row per place with its signals, readiness, reasons and lowest level coverage."""
    labels = place_labels(places).select("place_code", "place_label", "province_label", "region_short", "type_label")
    reasons = screen.select("place_code", F.col("not_assessed_reason").alias("_room_reason"), "ratio_count", "missing_room_count", "zero_room_count")
    lows = [F.when(F.col(f"{v.lower()}_offered_count") > 0, F.coalesce(f"{v.lower()}_learner_coverage_pct", F.lit(0.0))) for v in level_codes]
    above = [F.when(F.col(f"{v.lower()}_benchmark_status") == "above reference", v) for v in level_codes]
    wide = levels.select("place_code", F.col("not_assessed_reason").alias("_teacher_reason"), "offered_level_count",
                         F.least(*lows).alias("teacher_coverage_pct"), F.concat_ws(", ", *above).alias("levels_above"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    review = F.col("priority_category") == rules.PRIORITY_CATEGORIES[-1]
    return matrix.join(labels, "place_code").join(reasons, "place_code", "left").join(wide, "place_code", "left").withColumns({
        "room_signal": signal(F.col("room_flag"), F.col("room_assessed")),
        "teacher_signal": signal(F.col("teacher_flag"), F.col("teacher_assessed")),
        "growth_signal": F.when(F.col("is_growing"), GROWTH[0]).when(~F.col("is_growing"), GROWTH[1]).otherwise(GROWTH[2]),
        "pressure_signals": F.coalesce(F.nullif(F.concat_ws(" + ", F.when(F.col("room_flag") == 1, "Classroom"),
                                                            F.when(F.col("teacher_flag") == 1, "Teacher")), F.lit("")), F.lit("None identified")),
        "data_readiness": F.when(review, READINESS[2]).when(no("room_assessed") | no("teacher_assessed") | F.col("is_growing").isNull(), READINESS[1]).otherwise(READINESS[0]),
        "not_assessed_text": F.concat_ws("; ", F.when(no("room_assessed"), F.coalesce("_room_reason", F.lit("rooms not assessed"))),
                                         F.when(no("teacher_assessed"), F.coalesce("_teacher_reason", F.lit("teachers not assessed"))),
                                         F.when(F.col("is_growing").isNull(), F.coalesce("growth_not_assessed_reason", F.lit("trend not comparable")))),
    }).drop("_room_reason", "_teacher_reason")


def in_view(rows: DataFrame, region: str = ALL, province: str = ALL, place_type: str = ALL, category: str = ALL) -> DataFrame:
    """D-4: filtered rows with their position in view."""
    kept = rows.filter(chosen("region_name", region) & chosen("province_label", province) & chosen("type_label", place_type)
                       & chosen("priority_category", category))
    return position_in_order(kept, [F.col("priority_order").asc(), F.col("place_code").asc()], "rank_in_view")


def top(rows: DataFrame, n: int, rank: str = "rank_in_view") -> DataFrame:
    return rows.filter(F.col(rank) <= n)


def thin_ring(ring: Column, step: int) -> Column:
    """Every ``step``-th point of a ring, always keeping it closed."""
    return F.filter(ring, lambda p, i: (i % step == 0) | (i == F.size(ring) - 1))


def map_shapes(rows: DataFrame, shapes: DataFrame, step: int, geometry: str = "geometry") -> DataFrame:
    """D-5: places in view with a thinned outline; a place without a shape keeps its row."""
    from placegrid.functions.geo import rings

    thin = shapes.withColumn("outline", F.transform(rings(F.col(geometry)), lambda r: thin_ring(r, step))).select("place_code", "outline")
    return rows.join(thin, "place_code", "left")


def drawn_note(rows: DataFrame, shapes: DataFrame) -> DataFrame:
    drawn = shapes.select("place_code").distinct().withColumn("_d", F.lit(1))
    return rows.select("place_code").distinct().join(drawn, "place_code", "left").agg(
        F.concat(F.lit("Drawn "), F.format_number(F.count("_d"), 0), F.lit(" of "), F.format_number(F.count("*"), 0), F.lit(" places in view.")).alias("map_line"))


def national_kpis(rows: DataFrame) -> DataFrame:
    """D-6: counts and shares in one aggregate."""
    is_ = lambda *i: F.col("priority_category").isin(*[rules.PRIORITY_CATEGORIES[k] for k in i])
    k = rows.agg(F.count("*").alias("places"), F.count_if(~is_(5)).alias("assessed"), F.count_if(is_(0)).alias("joint_review"),
                 F.count_if(is_(0, 1, 2)).alias("any_pressure"), F.count_if(is_(5)).alias("data_review"),
                 F.sum(F.coalesce("room_affected_count", F.lit(0))).cast("bigint").alias("schools_above"),
                 F.sum(F.coalesce("room_affected_learners", F.lit(0))).cast("bigint").alias("learners_above"),
                 F.sum("public_enrollment").cast("bigint").alias("public_learners"))
    of = lambda c: F.concat(F.format_number(c, 0), F.lit(" of "), F.format_number("places", 0))
    share = F.concat(F.format_number(ratio(100 * F.col("learners_above"), F.col("public_learners")), 1), F.lit("%"))
    return k.withColumns({"joint_kpi": of("joint_review"), "any_kpi": of("any_pressure"), "data_review_kpi": of("data_review"),
                          "learners_share": F.coalesce(share, F.lit("-"))})


def signal_matrix(rows: DataFrame) -> DataFrame:
    """D-7: each combination of the two signals, how many places, how many growing, and the resulting status."""
    room, teacher = F.col("room_signal") == SIGNALS[0], F.col("teacher_signal") == SIGNALS[0]
    quiet = (F.col("room_signal") == SIGNALS[1]) & (F.col("teacher_signal") == SIGNALS[1])
    return rows.groupBy("room_signal", "teacher_signal").agg(
        F.count("*").alias("places"), F.count_if(F.col("growth_signal") == GROWTH[0]).alias("growing")).withColumn(
        "resulting_status", F.when(room & teacher, "Priority 1 or 2").when(room | teacher, "Priority 2 or 3")
        .when(quiet, "Monitor or no current pressure").otherwise("Data review"))


def share_within(rows: DataFrame, group: str, status: str, high: Sequence[str] = ()) -> DataFrame:
    """D-8/D-9: rows per group and status with their share of the group (and the group's share of ``high``)."""
    counts = rows.groupBy(group, status).agg(F.count("*").alias("places"))
    totals = counts.groupBy(group).agg(F.sum("places").alias("_total"), F.sum(F.when(F.col(status).isin(*high), F.col("places")).otherwise(0)).alias("_high"))
    out = counts.join(totals, group).withColumn("share", F.col("places").cast("double") / F.col("_total"))
    return (out.withColumn("high_share", F.col("_high").cast("double") / F.col("_total")) if high else out).drop("_total", "_high")


def census_pairs(trend: DataFrame, years: Sequence[int]) -> DataFrame:
    """D-10: population and enrollment of the census years side by side."""
    at = lambda y, c: F.max(F.when(F.col("census_year") == y, F.col(c)))
    return trend.filter(F.col("census_year").isNotNull()).groupBy("place_code").agg(
        *[at(y, "school_age_population").alias(f"population_{y}") for y in years],
        *[at(y, "all_enrollment").alias(f"enrolled_{y}") for y in years],
        F.min(F.col("is_geography_comparable").cast("int")).alias("comparable"))


def pair_series(rows: DataFrame, group: str, series: Mapping[str, str]) -> DataFrame:
    """D-11: group totals as a long series (``{label: column}``), largest first by the first series."""
    first = next(iter(series.values()))
    sums = rows.groupBy(group).agg(*[F.sum(c).cast("bigint").alias(c) for c in series.values()])
    packs = F.array(*[F.struct(F.lit(i).alias("series_order"), F.lit(label).alias("series"), F.col(c).alias("people"))
                      for i, (label, c) in enumerate(series.items(), 1)])
    return sums.filter(F.col(first).isNotNull()).select(group, F.col(first).alias("size_order"), F.inline(packs))


def pick_one(rows: DataFrame, label_col: str, label: str, order: str) -> DataFrame:
    """D-12/D-25: the requested row, else the best ranked: one minimum, no sort."""
    best = rows.agg(F.min(F.struct(F.when(F.col(label_col) == label, 0).otherwise(1).alias("a"), F.col(order).alias("b"), F.col("place_code").alias("c"))).alias("m"))
    return rows.join(F.broadcast(best.select(F.col("m.c").alias("place_code"))), "place_code", "left_semi")


def place_card(rows: DataFrame, label: str, **filters) -> DataFrame:
    """D-13: the picked place with its position in scope and the size of the scope."""
    view = in_view(rows, **filters)
    total = view.agg(F.count("*")).scalar()
    return pick_one(view, "place_label", label, "priority_order").withColumns({"scope_total": total}).select(
        "place_code", "place_label", "priority_category", "priority_order", F.col("rank_in_view").alias("scope_order"), "scope_total",
        F.when(~F.coalesce("room_assessed", F.lit(False)), "Not assessed").otherwise(
            F.concat(number(F.col("room_affected_count")), F.lit(" of "), number(F.col("ratio_count")))).alias("room_kpi"),
        "data_readiness")


def decision_rows(card: DataFrame) -> DataFrame:
    """D-14: why a place has its status, one row per signal."""
    yes = lambda c, names: F.when(F.col(c) == names[0], "Yes").when(F.col(c) == names[1], "No").otherwise("Not assessed")
    row = lambda i, what, result: F.struct(F.lit(i).alias("ord"), F.lit(what).alias("signal"), result.alias("result"))
    return card.select("place_code", F.inline(F.array(
        row(1, "Classroom pressure", yes("room_signal", SIGNALS)), row(2, "Teacher pressure", yes("teacher_signal", SIGNALS)),
        row(3, "Enrollment growing", yes("growth_signal", GROWTH)), row(4, "Review status", F.col("priority_category")))))


def evidence_rows(card: DataFrame, levels: DataFrame, references: Mapping[str, float]) -> DataFrame:
    """D-14: the measures beside their comparison points."""
    wide = card.join(levels.select("place_code", *[f"{v.lower()}_{c}" for v in references for c in
                                                   ("offered_count", "learners_per_teacher", "benchmark_status")]), "place_code")
    row = lambda i, what, value, status: F.struct(F.lit(i).alias("ord"), F.lit(what).alias("measure"), value.alias("value"), status.alias("status"))
    rows = [row(1, "Classroom pressure", F.col("learners_per_room"), F.col("room_signal"))]
    rows += [row(i, f"Teacher pressure {v}", F.col(f"{v.lower()}_learners_per_teacher"), F.col(f"{v.lower()}_benchmark_status"))
             for i, v in enumerate(references, 2)]
    rows += [row(2 + len(references), "School network context", F.col("learners_per_school"), F.lit("context only"))]
    return wide.select("place_code", F.inline(F.array(*rows)))


def reliability_rows(card: DataFrame) -> DataFrame:
    """D-15: coverage per measure and what was left out."""
    row = lambda i, what, coverage, assessed, note: F.struct(F.lit(i).alias("ord"), F.lit(what).alias("measure"), coverage.alias("coverage_pct"),
                                                            F.coalesce(assessed, F.lit(False)).alias("assessed"), note.alias("left_out"))
    return card.select("place_code", F.inline(F.array(
        row(1, "School network", F.col("provision_coverage_pct"), F.col("provision_assessed"), F.lit(0).cast("bigint")),
        row(2, "Classrooms", F.col("room_coverage_pct"), F.col("room_assessed"),
            F.coalesce("missing_room_count", F.lit(0)) + F.coalesce("zero_room_count", F.lit(0))),
        row(3, "Teachers", F.col("teacher_coverage_pct"), F.col("teacher_assessed"), F.lit(0).cast("bigint")))))


def level_shares(levels: DataFrame, references: Mapping[str, float]) -> DataFrame:
    """D-16: each offered level's ratio as a share of its reference."""
    packs = F.array(*[F.struct(
        F.lit(v).alias("level_code"), F.col(f"{v.lower()}_offered_count").alias("offered"), F.col(f"{v.lower()}_passes_gate").alias("passes"),
        F.col(f"{v.lower()}_learners_per_teacher").alias("ratio"), F.lit(float(ref)).alias("reference")) for v, ref in references.items()])
    rows = levels.select("place_code", F.inline(packs)).filter(F.col("offered") > 0)
    known = F.col("ratio").isNotNull() & F.col("passes")
    return rows.select("place_code", "level_code", F.when(known, F.col("ratio") / F.col("reference")).alias("share_of_reference"),
                       F.when(~known, "Not assessed").when(F.col("ratio") > F.col("reference"), "Above comparison point")
                       .otherwise("At or below comparison point").alias("status"))


def long_series(df: DataFrame, keep: Sequence[str], series: Mapping[str, str], label: str = "series", value: str = "value") -> DataFrame:
    """D-17/D-19: columns as rows of (label, value), one scan."""
    return df.select(*keep, F.inline(F.array(*[F.struct(F.lit(k).alias(label), F.col(c).alias(value)) for k, c in series.items()])))


def age_bands(population: DataFrame, first: int, second: int, by: Sequence[str] = ("place_code",), bands=rules.AGE_BANDS) -> DataFrame:
    """D-18: population per age band in two census years and the change."""
    band = None
    for label, low, high in bands:
        hit = F.col("age").between(low, high)
        band = F.when(hit, label) if band is None else band.when(hit, label)
    rows = population.filter(F.col("sex").isin("male", "female") & F.col("reference_year").isin(first, second)).withColumn("age_band", band)
    at = lambda y: F.sum(F.when(F.col("reference_year") == y, F.col("population"))).cast("bigint")
    out = rows.filter(F.col("age_band").isNotNull()).groupBy(*by, "age_band").agg(at(first).alias("children_first"), at(second).alias("children_second"))
    return out.withColumns({"change": ratio(F.col("children_second") - F.col("children_first"), F.col("children_first")),
                            "direction": F.when(F.col("children_first").isNull() | F.col("children_second").isNull(), "Not available")
                            .when(F.col("children_second") >= F.col("children_first"), "Increase").otherwise("Decrease")})


def peers(rows: DataFrame, label: str) -> DataFrame:
    """D-20: the selected place among its province (its region when it has none), ranked by affected learners."""
    me = rows.filter(F.col("place_label") == label).select(
        (F.col("province_label") == NO_PROVINCE).alias("_by_region"), "region_name", "province_label").limit(1)
    by_region, region, province = (me.select(c).scalar() for c in ("_by_region", "region_name", "province_label"))
    near = rows.filter(F.when(by_region, F.col("region_name") == region).otherwise(F.col("province_label") == province))
    ranked = position_in_order(near, [F.col("affected_learners").desc(), F.col("priority_order").asc()], "area_rank")
    return ranked.withColumns({"area_places": ranked.agg(F.count("*")).scalar(), "is_selected": F.col("place_label") == label})


def worklist(fact: DataFrame, rooms: DataFrame, teachers: DataFrame, flags: DataFrame, names: DataFrame, period: str,
             first: str, last: str, levels: Sequence[str], screen: float = rules.ROOM_SCREEN, annex: str = "Annex/Extension School") -> DataFrame:
    """D-21: each active or blank entity with its ratios, trend, seven things to verify, next step and list order.

    Everything is one row per entity before the joins; the order within a place is found without gathering the
    place's entities in one task.
    """
    public = fact.filter((F.col("sector") == "Public") & (F.col("match_status") == "matched"))
    offered = lambda v: F.coalesce(F.bool_or((F.col("level_code") == v) & F.col("is_offered")), F.lit(False))
    by_level = [a for v in levels for a in (offered(v).alias(f"offers_{v.lower()}"),
                F.sum(F.when((F.col("level_code") == v) & F.col("is_offered"), F.col("learner_count"))).alias(f"{v.lower()}_learners"))]
    now = in_scope(fact, period)
    wide = now.groupBy("entity_id", "place_code").agg(*by_level)
    base = entity_rollup(now, annex=annex).filter(F.col("is_active") | F.col("is_blank")).join(wide, ["entity_id", "place_code"])
    ends = public.filter(F.col("period").isin(first, last) & F.col("is_offered")).groupBy("entity_id").agg(
        F.sum(F.when(F.col("period") == first, F.col("learner_count"))).alias("_first"),
        F.sum(F.when(F.col("period") == last, F.col("learner_count"))).alias("_last"),
        F.count_if(F.col("learner_count").isNull()).alias("_open"))
    staff = teachers.filter(F.col("period") == period).groupBy("entity_id").agg(
        *[F.max(F.when(F.col("level_code") == v, F.col("teacher_count"))).alias(f"{v.lower()}_teachers") for v in levels])
    room = rooms.filter(F.col("period") == period).select("entity_id", "rooms")
    odd = flags.groupBy("entity_id").agg(F.bool_or("is_suspected").alias("_odd"))
    x = (base.join(room, "entity_id", "left").join(staff, "entity_id", "left").join(ends, "entity_id", "left")
         .join(odd, "entity_id", "left").join(names, "entity_id", "left"))
    off = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    complete = F.col("incomplete_levels") == 0
    per_room = F.when(complete & (F.col("rooms") > 0), ratio(F.col("complete_learners"), F.col("rooms")))
    any_level = lambda test: _any([F.col(f"offers_{v.lower()}") & test(F.col(f"{v.lower()}_teachers")) for v in levels])
    counted = [F.when(F.col(f"{v.lower()}_teachers") > 0, F.coalesce(f"{v.lower()}_learners", F.lit(0))).otherwise(0) for v in levels]
    staffed = [F.when(F.col(f"{v.lower()}_teachers") > 0, F.col(f"{v.lower()}_teachers")).otherwise(0) for v in levels]
    add = lambda cols: sum(cols[1:], cols[0])
    x = x.withColumns({
        "learners": F.when(complete, F.col("complete_learners")), "learners_per_room": per_room,
        "learners_per_teacher": ratio(add(counted), add(staffed)),
        "enrollment_change": F.when((F.col("_open") == 0) & (F.col("_first") > 0), ratio(F.col("_last") - F.col("_first"), F.col("_first"))),
        "f_above": off(per_room >= screen), "f_rooms_missing": off(F.col("rooms").isNull()), "f_rooms_zero": off(F.col("rooms") == 0),
        "f_learners_missing": off(~complete), "f_teachers_missing": off(any_level(lambda t: t.isNull())),
        "f_teachers_zero": off(~F.col("is_annex") & any_level(lambda t: F.coalesce(t == 0, F.lit(False)))), "f_outlier": off(F.col("_odd"))})
    flag_names = ["f_above", "f_rooms_missing", "f_rooms_zero", "f_learners_missing", "f_teachers_missing", "f_teachers_zero", "f_outlier"]
    on = lambda *c: _any([F.col(f) == 1 for f in c])
    x = x.withColumn("checks", add([F.col(f) for f in flag_names])).withColumns({
        "status": F.when(on("f_above"), "Above classroom screen").when(on("f_rooms_missing", "f_learners_missing", "f_teachers_missing"), "Missing figure")
        .when(on("f_rooms_zero", "f_teachers_zero"), "Zero reported").otherwise("Below classroom screen"),
        "why_listed": F.coalesce(F.nullif(F.concat_ws("; ", *[F.when(F.col(f) == 1, text) for f, text in WHY_LISTED]), F.lit("")),
                                 F.lit("Included by classroom-pressure order")),
        "next_step": F.when(on("f_rooms_missing", "f_rooms_zero"), "Verify reported room count").when(on("f_learners_missing"), "Verify enrollment by level")
        .when(on("f_teachers_missing", "f_teachers_zero"), "Verify teacher count by level").when(on("f_outlier"), "Verify the extreme room or teacher figure")
        .when(on("f_above"), "Verify reported room count and enrollment").otherwise("No figure to verify")}).drop("_first", "_last", "_open", "_odd")
    order = [F.when(F.col("checks") > 0, 0).otherwise(1).asc(), F.col("learners_per_room").desc_nulls_last(), F.col("entity_name").asc(), F.col("entity_id").asc()]
    return position_in_order(x, order, "list_order", by=["place_code"])


# What each flag asks to verify, in the order it is listed.
WHY_LISTED = (
    ("f_rooms_missing", "Missing room count"), ("f_rooms_zero", "Zero rooms reported"), ("f_learners_missing", "Missing learner count"),
    ("f_teachers_missing", "Missing teacher count"), ("f_teachers_zero", "Zero teachers reported"),
    ("f_outlier", "Suspected extreme figure"), ("f_above", "Above classroom screen"),
)


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def without_entity(sub_places: DataFrame, entities: DataFrame, key: str, has: Column) -> DataFrame:
    """D-22: sub-places where no matched entity satisfies ``has``, with what they do have."""
    held = entities.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("entities"), F.coalesce(F.bool_or(has), F.lit(False)).alias("_has"))
    return (sub_places.join(held, key, "left").filter(~F.coalesce("_has", F.lit(False))).drop("_has")
            .withColumn("entities", F.coalesce("entities", F.lit(0)).cast("bigint")))


def location_note(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """D-23: how many points are drawn and why the others are not."""
    n = lambda *s: F.count_if(F.col("boundary_status").isin(*s))
    return points.groupBy(*by).agg(F.count("*").alias("entities"), n("inside").alias("mapped"), n("outside").alias("outside"),
                                   n("no_usable_point").alias("no_usable_point"), n("no_matched_city", "no_boundary").alias("not_validated"))


def entity_trend(fact: DataFrame, period: str = "period") -> DataFrame:
    """D-27: each entity's total per period, and its levels when it has more than one."""
    rows = fact.filter("is_offered").groupBy("entity_id", period, "level_code").agg(F.sum("learner_count").cast("bigint").alias("learners"))
    levels = rows.groupBy("entity_id").agg(F.count_distinct("level_code").alias("_n"))
    total = rows.groupBy("entity_id", period).agg(F.sum("learners").cast("bigint").alias("learners")).withColumn("series", F.lit("All levels"))
    per_level = rows.join(levels.filter("_n > 1"), "entity_id").select("entity_id", period, "learners", F.col("level_code").alias("series"))
    return total.select("entity_id", period, "series", "learners").unionByName(per_level)


def rooms_table(listed: DataFrame, levels: Sequence[str]) -> DataFrame:
    """D-28: one row per offered level plus the whole entity."""
    packs = [F.struct(F.lit(i).alias("ord"), F.lit(v).alias("level"), F.col(f"offers_{v.lower()}").alias("_on"), F.col(f"{v.lower()}_learners").alias("learners"),
                      F.col(f"{v.lower()}_teachers").alias("teachers"), F.lit(None).cast("bigint").alias("rooms")) for i, v in enumerate(levels, 1)]
    staff = [F.coalesce(f"{v.lower()}_teachers", F.lit(0)) for v in levels]
    packs.append(F.struct(F.lit(len(levels) + 1).alias("ord"), F.lit("Whole school").alias("level"), F.lit(True).alias("_on"),
                          F.col("learners").alias("learners"), sum(staff[1:], staff[0]).alias("teachers"), F.col("rooms").cast("bigint").alias("rooms")))
    return listed.select("entity_id", F.inline(F.array(*packs))).filter("_on").drop("_on")


def verify_items(listed: DataFrame) -> DataFrame:
    """D-29: one row per figure to verify; one 'nothing to verify' row for an entity without any."""
    items = F.array_compact(F.array(*[F.when(F.col(f) == 1, F.struct(F.lit(i).alias("ord"), F.lit(t).alias("item")))
                                      for i, (f, t) in enumerate(WHY_LISTED, 1)],
                                    F.when(F.col("checks") == 0, F.struct(F.lit(8).alias("ord"), F.lit("No figure to verify").alias("item")))))
    return listed.select("place_code", "entity_id", F.inline(items))


def health(runs: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """D-31: one line: last success, checks and failures among the newest result of each check."""
    newest = tie_ranked_first(results, key, "checked_at").agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "FAIL").alias("failed"))
    last = runs.filter(F.col("status") == "succeeded").agg(F.max("finished_at").cast("date")).scalar()
    return newest.select(F.coalesce(last.cast("string"), F.lit("Not available")).alias("updated"), "checks", "failed",
                         F.when(F.col("checks") == 0, "No checks recorded").when(F.col("failed") > 0, "Needs attention").otherwise("Ready").alias("publication_status"))


def method_kpis(rows: DataFrame) -> DataFrame:
    """D-32: how many places each measure could be assessed for."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return rows.agg(F.count("*").alias("places"), yes("room_assessed").alias("room_assessed"), yes("teacher_assessed").alias("teacher_assessed"),
                    F.count_if(F.col("offered_level_count") > 0).alias("offering"), F.count("is_growing").alias("trends_comparable"),
                    F.count_if(F.col("priority_category") == rules.PRIORITY_CATEGORIES[-1]).alias("data_review"))


def trend_status(trend: DataFrame) -> DataFrame:
    """D-32: places by whether their trend is complete and comparable."""
    per = trend.filter(F.col("member_type") == "regular").groupBy("place_code").agg(
        F.max((F.col("incomplete") > 0).cast("int")).alias("_open"), F.min(F.col("is_geography_comparable").cast("int")).alias("_same"))
    return per.groupBy(F.when(F.col("_open") == 1, "An incomplete school year").when(F.col("_same") == 0, "Boundaries changed")
                       .otherwise("Complete and comparable").alias("trend_status")).agg(F.count("*").alias("places"))


def coverage_bands(rows: DataFrame, measures: Mapping[str, tuple[str, str | None]], threshold: float = rules.COVERAGE_THRESHOLD) -> DataFrame:
    """D-33: places per measure and band (``{measure: (coverage column, condition or None)}``) with shares."""
    packs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).alias("coverage"), (F.expr(w) if w else F.lit(True)).alias("on"))
                      for m, (c, w) in measures.items()])
    band = (F.when(F.col("coverage").isNull(), COVERAGE_BANDS[2]).when(F.col("coverage") < threshold, COVERAGE_BANDS[1]).otherwise(COVERAGE_BANDS[0]))
    return share_within(rows.select(F.inline(packs)).filter("on").withColumn("coverage_status", band), "measure", "coverage_status")


def review_reasons(rows: DataFrame, reasons: Mapping[str, str]) -> DataFrame:
    """D-34: why data-review places could not be assessed, per measure (``{measure: reason column}``)."""
    packs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).alias("reason")) for m, c in reasons.items()])
    return (rows.filter(F.col("priority_category") == rules.PRIORITY_CATEGORIES[-1]).select(F.inline(packs))
            .filter(F.col("reason").isNotNull()).groupBy("measure", "reason").agg(F.count("*").alias("places")))


def share_band(learners: Column, share: Column) -> Column:
    """D-35."""
    return (F.when(F.coalesce(learners, F.lit(0)) == 0, SHARE_BANDS[0]).when(share < 10, SHARE_BANDS[1]).when(share < 25, SHARE_BANDS[2])
            .when(share < 50, SHARE_BANDS[3]).otherwise(SHARE_BANDS[4]))


def availability_matrix(grid: DataFrame, periods: Sequence[str], source: str = "source_id", period: str = "period") -> DataFrame:
    """D-36: one row per source, one column per period."""
    wide = grid.groupBy(source).pivot(period, list(periods)).agg(F.max(F.col("has_data").cast("int")))
    return wide.select(source, *[F.when(F.col(f"`{p}`") == 1, "Available").otherwise("Not available").alias(f"p_{p.replace('-', '_')}") for p in periods])


def options(rows: DataFrame, column: str, first: str = ALL, **filters) -> DataFrame:
    """D-37: the values a filter can take under the filters above it, '(All)' first."""
    kept = rows
    for c, v in filters.items():
        kept = kept.filter(chosen(c, v))
    values = kept.select(F.col(column).alias("option")).filter(F.col("option").isNotNull()).distinct().withColumn("ord", F.lit(1))
    head = literal_table(rows.sparkSession, [(first, 0)], "option string, ord int")
    return head.unionByName(values)


def reference_table(spark, references: Mapping[str, float] = rules.TEACHER_REFERENCES, screen: float = rules.ROOM_SCREEN) -> DataFrame:
    """D-38: the comparison points as a table."""
    rows = [("Classroom pressure", "ALL", float(screen), "at or above")]
    rows += [("Teacher pressure", level, float(value), "above") for level, value in references.items()]
    return literal_table(spark, rows, "measure string, level_code string, reference double, comparison string")


def rule_table(spark) -> DataFrame:
    """D-38: how each category is assigned."""
    p1, p2, p3, monitor, none, review = rules.PRIORITY_CATEGORIES
    return literal_table(spark, 
        [(p1, 2, "yes"), (p2, 2, "no or unknown"), (p2, 1, "yes"), (p3, 1, "no or unknown"), (monitor, 0, "yes"),
         (none, 0, "no"), (review, 0, "unknown, or a gate failed")], "priority_category string, pressures int, growing string")
