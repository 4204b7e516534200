"""Matching plans: every record gets one official place code, or a status that says why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placegrid.functions import keys, text
from placegrid.operators import matching, spatial
from placegrid.operators.modelling import latest_release


def unit_keys(units: DataFrame) -> DataFrame:
    """Reference units with the key ladder of their current and old names, and the city a district rolls up to."""
    named = keys.name_keys(keys.name_keys(units, "name"), "old_names", "ok_")
    parents = units.select(F.col("psgc_code").alias("city_municipality_code"), F.col("geographic_level").alias("_level"))
    rolled = named.join(parents, "city_municipality_code", "left")
    return rolled.withColumn("city_roll", F.when(F.col("_level") == "SubMun", text.ancestor_code("city_municipality_code", 5, 10))
                             .otherwise(F.col("city_municipality_code"))).drop("_level")


def roll_up(code: str, level: str) -> Column:
    """I-11: a city district counts as its city."""
    return F.when(F.col(level) == "SubMun", text.ancestor_code(code, 5, 10)).otherwise(F.col(code))


def match_city_names(names: DataFrame, units: DataFrame, aliases: DataFrame, region_scopes: dict[str, str]) -> DataFrame:
    """City or municipality of each distinct (province, municipality), inside its province first, then independent cities.

    ``region_scopes`` names regions that have no provinces: ``{text in the province name: region code}``.
    """
    key = ["province", "municipality"]
    keyed = keys.name_keys(names.select(*key).distinct(), "municipality")
    said = keys.name_keys(names.select("province").distinct(), "province")
    provinces = units.filter((F.col("geographic_level") == "Prov") | (F.col("level_blank") & (F.col("psgc_code") == F.col("province_code"))))
    found = matching.parents_at_best_tier(said, ["province"], provinces, "psgc_code")
    prefixes = found.select("province", F.substring("psgc_code", 1, 5).alias("_prefix")).distinct()
    hits = prefixes.groupBy("province").agg(F.collect_set("_prefix").alias("_prefixes"))
    scoped = keyed.alias("k").join(hits.alias("h"), F.col("k.province").eqNullSafe(F.col("h.province")), "left").select("k.*", "h._prefixes")
    region = F.lit(None).cast("string")
    for word, code in region_scopes.items():
        region = F.when(F.contains(F.upper("province"), F.lit(word)), F.lit("R" + code)).otherwise(region)
    first = F.concat(F.coalesce("_prefixes", F.array().cast("array<string>")), F.when(region.isNotNull(), F.array(region)).otherwise(F.array().cast("array<string>")))
    wide = F.when(F.col("_prefixes").isNull(), "CITY").otherwise("INDEPENDENT")
    scopes = F.concat(F.transform(first, lambda s: F.struct(F.lit(1).alias("scope_rank"), s.alias("scope"))),
                      F.array(F.struct(F.lit(2).alias("scope_rank"), wide.alias("scope"))))
    records = scoped.withColumn("_s", F.explode(scopes)).select(*keyed.columns, "_s.*")
    cities = units.filter(F.col("geographic_level").isin("City", "Mun", "SubMun"))
    is_city, independent = F.col("geographic_level") == "City", F.substring("psgc_code", 6, 5) == "00000"
    offered = F.array_compact(F.array(F.substring("psgc_code", 1, 5), F.concat(F.lit("R"), F.col("region_code")),
                                      F.when(is_city, "CITY"), F.when(is_city & independent, "INDEPENDENT")))
    reference = matching.reference_keys(cities.withColumn("scope", F.explode(offered)), "psgc_code", ["scope"])
    result = matching.resolve(records, key, reference, ["scope"], rank="scope_rank")
    levels = units.select(F.col("psgc_code").alias("code"), F.col("geographic_level").alias("level"))
    reviewed = keyed.join(aliases.select(F.col("name").alias("k_exact"), F.col("psgc_code").alias("reviewed_code"), "reason"), "k_exact").select(*key, "reviewed_code", "reason")
    decided = matching.apply_reviewed(result, reviewed, key)
    return decided.join(levels, "code", "left").select(
        *key, F.col("code").alias("name_city_code"), F.col("level").alias("name_city_level"), F.col("match_method").alias("name_city_method"), F.col("hits").alias("name_city_hits"))


def match_sub_unit_names(places: DataFrame, units: DataFrame) -> DataFrame:
    """Barangay of each distinct (city found by name, barangay name); a cut-off name may match by its beginning."""
    subs = units.filter(F.col("geographic_level") == "Bgy").withColumn("name_city_code", F.col("city_municipality_code"))
    key = ["name_city_code", "barangay"]
    keyed = keys.name_keys(places.filter(F.col("name_city_code").isNotNull()).select(*key, "barangay_possibly_truncated").distinct(), "barangay")
    result = matching.resolve(keyed, key, matching.reference_keys(subs, "psgc_code", ["name_city_code"]), ["name_city_code"])
    cut = matching.prefix_match(keyed.filter("barangay_possibly_truncated"), key, "k_folded", subs, "k_folded", "psgc_code", "name_city_code")
    joined = result.alias("r").join(cut.alias("c"), [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in key], "left")
    by_name = F.col("r.tier").isNotNull()
    return joined.select("r.name_city_code", "r.barangay", F.when(by_name, F.col("r.code")).otherwise(F.col("c.code")).alias("name_bgy_code"),
                         F.when(by_name, F.col("r.match_method")).when(F.col("c.code").isNotNull(), "name_normalized").alias("name_bgy_method"))


def map_entities(enrollment: DataFrame, crosswalk: DataFrame, units: DataFrame, aliases: DataFrame, region_scopes: dict[str, str],
                 excluded: Column | None = None) -> DataFrame:
    """The school map: code and name evidence decided per level, one row per school, period and level.

    Names are matched once per distinct spelling, codes by equality; both results join back to the schools.
    """
    keyed = unit_keys(units)
    cities = match_city_names(enrollment, keyed, aliases, region_scopes)
    rows = enrollment.withColumn("barangay", F.coalesce("barangay", F.lit("")))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("province", "municipality")]
    rows = rows.alias("l").join(cities.alias("r"), same, "left").select("l.*", "r.name_city_code", "r.name_city_level", "r.name_city_method", "r.name_city_hits")
    subs = match_sub_unit_names(rows, keyed)
    rows = rows.join(subs, ["name_city_code", "barangay"], "left").join(crosswalk, "entity_id", "left")
    levels = keyed.select(F.col("psgc_code").alias("code_city"), F.col("geographic_level").alias("code_city_level")).filter(F.col("code_city_level").isin("City", "Mun", "SubMun"))
    sub_units = keyed.filter(F.col("geographic_level") == "Bgy").select(
        F.col("psgc_code").alias("code_bgy"), F.col("k_exact").alias("_ue"), F.col("ok_exact").alias("_uo"), F.col("k_folded").alias("_uf"), F.col("ok_folded").alias("_uof"),
        F.col("k_bracketless").alias("_ub"), F.col("k_wordless").alias("_uw"), F.col("city_municipality_code").alias("code_bgy_parent"))
    rows = keys.name_keys(rows.join(levels, "code_city", "left").join(sub_units, "code_bgy", "left"), "barangay", "b_")
    agrees = F.lit(False)
    for a, b in (("b_exact", "_ue"), ("b_exact", "_uo"), ("b_folded", "_uf"), ("b_folded", "_uof"), ("b_bracketless", "_ub"), ("b_wordless", "_uw")):
        agrees = agrees | F.coalesce(F.col(a) == F.col(b), F.lit(False))
    agrees = agrees | F.coalesce(F.col("barangay_possibly_truncated") & F.col("_uf").startswith(F.col("b_folded")), F.lit(False))
    has_unit = F.col("code_bgy_parent").isNotNull()
    rows = rows.withColumns({
        "code_bgy_agrees": agrees & (F.col("barangay") != ""), "code_city_roll": F.when(F.col("code_city_level").isNotNull(), roll_up("code_city", "code_city_level")),
        "name_city_roll": roll_up("name_city_code", "name_city_level"), "code_bgy_unit": F.when(has_unit, F.col("code_bgy"))})
    supported = F.col("code_bgy_agrees") & (F.col("code_bgy_parent") == F.col("code_city"))
    city = matching.arbitrate(rows, "code_city_roll", "name_city_roll", supported, F.lit(False) if excluded is None else excluded).withColumnsRenamed(
        {"decided_code": "city_code", "match_status": "city_status", "match_method": "city_method", "reason": "city_reason"})
    low = matching.arbitrate(city, "code_bgy_unit", "name_bgy_code", F.col("code_bgy_agrees"), F.lit(False))
    parents = keyed.filter(F.col("geographic_level") == "Bgy").select(F.col("psgc_code").alias("decided_code"), F.col("city_roll").alias("_roll"))
    low = low.join(parents, "decided_code", "left")
    open_city = F.col("city_status") != "matched"
    outside = (F.col("match_status") == "matched") & ~F.coalesce(F.col("_roll") == F.col("city_code"), F.lit(False))
    low = low.withColumns({
        "bgy_status": F.when(open_city, F.col("city_status")).when(outside, "ambiguous").otherwise(F.col("match_status")),
        "bgy_code": F.when(~open_city & ~outside, F.col("decided_code")), "bgy_method": F.when(~open_city & ~outside, F.col("match_method")),
        "bgy_reason": F.when(open_city, F.concat(F.lit("city or municipality "), F.col("city_status"))).when(outside, "outside the accepted city or municipality").otherwise(F.col("reason"))})
    level = lambda name, p: F.struct(F.lit(name).alias("geographic_level"), F.col(f"{p}_code").alias("psgc_code"), F.col(f"{p}_status").alias("match_status"),
                                     F.col(f"{p}_method").alias("match_method"), F.col(f"{p}_reason").alias("reason"))
    return low.select("entity_id", "period", F.inline(F.array(level("city_mun", "city"), level("bgy", "bgy"))))


def map_estimates(estimates: DataFrame, units: DataFrame) -> DataFrame:
    """Poverty estimates by correspondence code, never by name; the names are only compared."""
    known = units.select("psgc_code", "correspondence_code", "geographic_level", F.col("name").alias("psgc_name"))
    hits = matching.first_code_rule(estimates, ["estimate_year", "psgc_id"], known, "psgc_code", [("correspondence_code", F.col("correspondence_code"), "correspondence_code")])
    out = estimates.join(hits.select("estimate_year", "psgc_id", "hits", F.col("code").alias("psgc_code")), ["estimate_year", "psgc_id"], "left")
    out = out.withColumn("psgc_code", F.when(F.col("hits") == 1, F.col("psgc_code"))).join(known.select("psgc_code", "geographic_level", "psgc_name"), "psgc_code", "left")
    level = F.when(F.col("geographic_level").isin("City", "Mun"), "city_mun").when(F.col("geographic_level") == "SubMun", "sub_mun")
    return out.withColumns({
        "match_status": F.when(F.col("hits") == 1, "matched").when(F.col("hits") > 1, "ambiguous").otherwise("unmatched"), "geographic_level": level,
        "names_agree": F.coalesce(keys.folded_key(keys.exact_key("municipality")) == keys.folded_key(keys.exact_key("psgc_name")), F.lit(False))})


def map_boundaries(features: DataFrame, units: DataFrame, overrides: DataFrame, moved: tuple[str, str] = ("19", "09")) -> DataFrame:
    """Boundary features by three code rules with agreeing names, else by name inside the feature's province."""
    old9 = lambda c: F.concat(F.substring(c, 1, 2), F.substring(c, 4, 2), F.substring(c, 6, 2), F.substring(c, 8, 3))
    key = ["adm3_pcode", "valid_on"]
    rows = keys.name_keys(features, "adm3_name").withColumns({
        "code10": F.rpad(F.substring("adm3_pcode", 3, 10), 10, "0"), "prov10": F.rpad(F.substring("adm2_pcode", 3, 10), 10, "0")})
    cities = unit_keys(units).filter(F.col("geographic_level").isin("City", "Mun"))
    agree = F.lit(False)
    for _, a, b, _ in matching.NAME_LADDER:
        agree = agree | F.coalesce(F.col(f"l.{a}") == F.col(f"u.{b}"), F.lit(False))
    plain = F.substring("code10", 3, 1) == "0"
    by_code = matching.first_code_rule(rows, key, cities, "psgc_code", [
        ("code", F.col("code10"), "psgc_code"), ("correspondence_code", F.when(plain, old9(F.col("code10"))), "correspondence_code"),
        ("code_region_moved", F.when(F.col("code10").startswith(moved[0]), F.concat(F.lit(moved[1]), F.substring("code10", 3, 8))), "psgc_code")], agree,
        ["k_exact", "k_folded", "k_bracketless", "k_wordless"])
    provinces = units.select("psgc_code", "correspondence_code")
    parent = matching.first_code_rule(rows, key, provinces, "psgc_code", [
        ("code", F.col("prov10"), "psgc_code"), ("correspondence_code", F.when(F.substring("prov10", 3, 1) == "0", old9(F.col("prov10"))), "correspondence_code")])
    scoped = rows.join(parent.select(*key, F.substring("code", 1, 5).alias("scope")), key)
    by_name = matching.resolve(scoped, key, matching.reference_keys(cities.withColumn("scope", F.substring("psgc_code", 1, 5)), "psgc_code", ["scope"]), ["scope"])
    n = by_name.select(*key, F.col("hits").alias("name_hits"), F.col("code").alias("name_code"), F.col("match_method").alias("name_method"))
    out = rows.join(by_code, key, "left").join(n, key, "left").join(overrides.withColumn("_o", F.lit(True)), key, "left")
    over, one, many, named = F.col("_o").isNotNull(), F.col("hits") == 1, F.col("hits") > 1, F.col("name_hits") == 1
    method = F.when(F.col("rule") == 1, "code").when(F.col("rule") == 2, "correspondence_code").when(F.col("rule") == 3, "code_region_moved")
    return out.select(
        *key, "adm3_name", "adm2_pcode",
        F.when(over, F.col("reviewed_code")).when(one, F.col("code")).when(many, F.lit(None)).when(named, F.col("name_code")).alias("psgc_code"),
        F.when(over & F.col("reviewed_code").isNull(), "unmatched").when(over | one, "matched").when(many, "ambiguous").when(named, "matched")
        .when((F.col("name_hits") > 1) | F.col("any_code").isNotNull(), "ambiguous").otherwise("unmatched").alias("match_status"),
        F.when(over, F.col("reviewed_method")).when(one, method).when(named & ~F.coalesce(many, F.lit(False)), F.col("name_method")).alias("match_method"),
        F.when(over, "reviewed").when(one | (F.col("hits").isNull() & named), "rule").otherwise("pending").alias("review_status"))


def map_census_places(places: DataFrame, units: DataFrame, regions: DataFrame, aliases: DataFrame, overrides: DataFrame) -> DataFrame:
    """Census places by name inside their matched province, or inside their region when it has none.

    ``regions``: census_year, region_name, region2 (listed region prefixes). ``aliases``: census_year, province_name, psgc_code.
    """
    key = ["census_year", "place_name", "parent_name"]
    keyed = unit_keys(units)
    parents = keyed.filter((F.col("geographic_level") == "Prov") | F.col("level_blank")).withColumn("region2", F.substring("psgc_code", 1, 2))
    said = places.filter(F.col("province_name").isNotNull()).select("census_year", "region_name", "province_name").distinct()
    said = keys.name_keys(said.join(regions, ["census_year", "region_name"]), "province_name")
    pair = ["census_year", "province_name"]
    found = matching.parents_at_best_tier(said, pair, parents, "psgc_code", ["region2"])
    single = found.groupBy(*pair).agg(F.count_distinct("psgc_code").alias("n"), F.min("psgc_code").alias("psgc_code")).filter("n = 1").drop("n")
    scopes = aliases.select(*pair, F.col("psgc_code").alias("scope")).unionByName(
        single.join(aliases.select(*pair).distinct(), pair, "left_anti").select(*pair, F.col("psgc_code").alias("scope")))
    direct = regions.select("census_year", "region_name", F.concat(F.lit("R"), F.col("region2")).alias("scope"))
    inside = places.join(scopes, pair).unionByName(places.filter(F.col("province_name").isNull()).join(direct, ["census_year", "region_name"]), allowMissingColumns=True)
    cities = keyed.filter(F.col("geographic_level").isin("City", "Mun")).withColumn(
        "scope", F.coalesce("province_code", F.concat(F.lit("R"), F.substring("psgc_code", 1, 2))))
    result = matching.resolve(keys.name_keys(inside, "place_name"), key, matching.reference_keys(cities, "psgc_code", ["scope"]), ["scope"])
    everything = places.select(*key).distinct().join(result, key, "left").withColumn("match_status", F.coalesce("match_status", F.lit("unmatched")))
    decided = matching.apply_reviewed(everything, overrides, key)
    return places.join(decided.select(*key, F.col("code").alias("psgc_code"), "match_status", "match_method", "review_status", "reviewed_reason"), key, "left")


def map_annexes(enrollment: DataFrame, annex_label: str) -> DataFrame:
    """Annexes stay visible without a mother school: no published column names it."""
    rows = enrollment.select("entity_id", "period", "annex_status")
    return matching.unmatched_by_design(rows, F.col("annex_status") == annex_label, "mother_entity_id", "no mother school is published")


def map_entity_boundary(locations: DataFrame, entity_map: DataFrame, boundary_map: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Point-in-boundary status of each located school, against the latest release and only the location's periods."""
    cities = entity_map.filter((F.col("geographic_level") == "city_mun") & (F.col("match_status") == "matched"))
    cities = cities.join(locations.select("period").distinct(), "period", "left_semi").select("period", "entity_id", F.col("psgc_code").alias("place_code"))
    release = latest_release(boundary_map, "valid_on").filter(F.col("match_status") == "matched").select("adm3_pcode", "valid_on", F.col("psgc_code").alias("place_code"))
    shapes = boundaries.filter("geometry_is_valid").select("adm3_pcode", "valid_on", "geometry").join(release, ["adm3_pcode", "valid_on"]).withColumnRenamed("adm3_pcode", "shape_id")
    return spatial.boundary_status(locations.join(cities, ["period", "entity_id"], "left"), shapes, ["period", "entity_id"])
