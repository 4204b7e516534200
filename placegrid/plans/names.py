"""Column names of published planning tables and the package's names for them."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Published column name to package column name.
COLUMNS = {
    "school_id": "entity_id", "school_name": "entity_name", "school_year": "period", "education_level_code": "level_code",
    "city_mun_psgc_code": "place_code", "city_mun_name": "place_name", "lgu_type": "place_type", "province_psgc_code": "province_code",
    "region_psgc_code": "region_code", "psgc_match_status": "match_status", "instructional_classrooms_total": "rooms",
    "is_2020_2024_geography_comparable": "is_geography_comparable",
}


def to_package(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in COLUMNS.items() if old in df.columns})


def to_published(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({new: old for old, new in COLUMNS.items() if new in df.columns})
