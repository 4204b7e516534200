"""Readers for delivered files (S-1, S-2, S-3, S-5)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from placegrid.operators.scale import running_sum
from placegrid.session import materialize
from placegrid.sources.contract import text_schema


def _numbered(rows: DataFrame, columns: Sequence[str], first: int) -> DataFrame:
    """File-order row numbers: counted inside each split, shifted by the splits before it in the same file."""
    tagged = rows.select(*columns, F.col("_metadata.file_path").alias("source_file"),
                         F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("source_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("source_file", "_start").count()
               .withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count"))
    inside = F.row_number().over(Window.partitionBy("source_file", "_start").orderBy("_id"))
    return (tagged.withColumn("_n", inside).join(offsets, ["source_file", "_start"])
            .withColumn("source_row_number", F.col("_n") + F.col("_shift") + (first - 1)).drop("_n", "_start", "_id", "_shift"))


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8",
                   delimiter: str = ",") -> DataFrame:
    """S-1: every column as text, a published blank as '', ragged rows refused, header checked, rows numbered from 1."""
    rows = (spark.read.schema(text_schema(columns)).option("header", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").option("encoding", encoding).option("sep", delimiter)
            .option("quote", "\"").option("escape", "\"").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return _numbered(rows, columns, 1).withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in columns})


def undecodable(columns: Sequence[str]) -> Column:
    """S-1: the decoder's replacement mark, which a strict reader would have refused."""
    return F.exists(F.array(*[F.col(c) for c in columns]), lambda x: F.contains(x, F.lit("\ufffd")))


def feature_property(text: Column, name: str) -> Column:
    """A property of a feature as published: digits are not normalized; a quoted value loses its quotes."""
    raw = F.regexp_extract(text, f'"{name}"[ ]*:[ ]*("(?:[^"\\\\]|\\\\.)*"|[^,}}\\]]+)', 1)
    trimmed = F.trim(raw)
    quoted = trimmed.startswith('"')
    unquoted = F.get_json_object(F.concat(F.lit('{"v":'), trimmed, F.lit("}")), "$.v")
    return F.when((trimmed == "") | (trimmed == "null"), F.lit(None).cast("string")).when(quoted, unquoted).otherwise(trimmed)


_TEXT = r'"(?:[^"\\]++|\\.)*+"'


def _object(depth: int) -> str:
    """An object with up to ``depth`` objects inside each other; parts are taken whole, so long lines cost one pass."""
    return rf'\{{(?:[^{{}}"]++|{_TEXT}{"|" + _object(depth - 1) if depth else ""})*+\}}'


_IS_FEATURE = r'"type"\s*:\s*"Feature"'
#: What stands beside the type: members with texts, numbers, objects and plain arrays, so a collection is no feature.
_MEMBER = rf'(?:(?!{_IS_FEATURE})(?:[^{{}}"\[\]]++|{_TEXT}|\[[^\[\]{{}}"]*+\]|{_object(5)}))*+'
_FEATURE = rf'\{{{_MEMBER}{_IS_FEATURE}{_MEMBER}\}}'


_PROPERTIES = rf'"properties"\s*:\s*({_object(5)})'
_GEOMETRY = rf'"geometry"\s*:\s*({_object(5)})'
#: A line in parts: texts, brackets, and what is between; an array of plain numbers is one part.
_PARTS = rf'({_TEXT}|\[[^\[\]{{}}"]*+\]|[{{}}\[\]]|[^"{{}}\[\]]++)'


def _spread_features(lines: DataFrame) -> DataFrame:
    """Features of collections that are laid out freely over lines: source_file, source_row_number, _place and value.

    A text never goes over the end of a line, so every line is cut into its parts alone. Running sums over the lines
    give the depth that a line starts at and the features before it, windows inside a line the rest. The objects that
    open at the third depth are put together, each in its own group.
    """
    step = F.when(F.col("_part").isin("{", "["), 1).when(F.col("_part").isin("}", "]"), -1).otherwise(0)
    parts = lines.select("source_file", "source_row_number", F.posexplode(F.regexp_extract_all("value", F.lit(_PARTS), 1)).alias("_k", "_part"))
    inside = Window.partitionBy("source_file", "source_row_number").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("_step", step).withColumn("_inside", F.sum("_step").over(inside))
    turns = parts.groupBy("source_file", "source_row_number").agg(F.sum("_step").alias("_turn"))
    starts = running_sum(turns, ["source_file"], "source_row_number", {"_end": "_turn"})
    line = ["source_file", "source_row_number"]
    parts = parts.join(starts.select(*line, (F.col("_end") - F.col("_turn")).alias("_start")), line)
    after = F.col("_start") + F.col("_inside")
    parts = parts.withColumn("_after", after).withColumn("_before", after - F.col("_step"))
    parts = parts.where("_after >= 3 OR _before >= 3").withColumn("_opens", ((F.col("_part") == "{") & (F.col("_before") == 2)).cast("int"))
    parts = parts.withColumn("_opened", F.sum("_opens").over(inside))
    opened = parts.groupBy(*line).agg(F.sum("_opens").alias("_own"))
    before = running_sum(opened, ["source_file"], "source_row_number", {"_all": "_own"}).select(*line, (F.col("_all") - F.col("_own")).alias("_earlier"))
    parts = parts.join(before, line).withColumn("_feature", F.col("_earlier") + F.col("_opened"))
    text = F.when(F.col("_k") == 0, F.concat(F.lit("\n"), F.col("_part"))).otherwise(F.col("_part"))
    whole = parts.groupBy("source_file", "_feature").agg(
        F.min("source_row_number").alias("source_row_number"), F.array_sort(F.collect_list(F.struct("source_row_number", "_k", text.alias("t")))).alias("_all"),
        F.min_by("_opened", F.struct("source_row_number", "_k")).alias("_opened"))
    value = F.ltrim(F.array_join(F.transform("_all", lambda p: p["t"]), ""), F.lit("\n "))
    return (whole.select(*line, (F.col("_opened") - 1).alias("_place"), value.alias("value")).where(F.get_json_object("value", "$.type") == "Feature"))


def read_features(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """S-2: one row per GeoJSON feature, properties and geometry as exact text, first line and place in that line from 1.

    A line may hold a feature, several or a whole collection. Where a feature does not end on its line, the file must
    be one collection, laid out over lines in any way. Features that cannot be told apart, and properties that hold an
    object or an array, are refused. A geometry keeps its own text, whatever it nests.
    """
    rows = _numbered(spark.read.text(path), ["value"], 1)
    found = F.regexp_extract_all("value", F.lit(f"({_FEATURE})"), 1)
    rows = rows.withColumn("_marks", F.regexp_count("value", F.lit(_IS_FEATURE)).cast("long")).withColumn("_found", F.when(F.col("_marks") > 0, found).otherwise(F.array().cast("array<string>")))
    # a type may stand on the line after its name
    whole = (F.size("_found") == F.col("_marks")) & (F.regexp_count("value", F.lit('"Feature"')) <= F.col("_marks"))
    # lines are matched once, and features put together once: both are read again
    rows = materialize(rows.withColumn("_whole", whole))
    layout = rows.groupBy("source_file").agg(F.sum("_marks").alias("_told"), F.min(F.when(~F.col("_whole"), F.col("source_row_number"))).alias("_torn"))
    rows = rows.join(layout, "source_file")
    flat = rows.where("_torn IS NULL AND _marks > 0").select("source_file", "source_row_number", F.posexplode("_found").alias("_place", "value"))
    torn = rows.where("_torn IS NOT NULL")
    spread = materialize(_spread_features(torn))
    counts = spread.groupBy("source_file").agg(F.count(F.lit(1)).alias("_got"))
    told = F.raise_error(F.concat(F.lit("features not told apart in line "), F.col("_torn").cast("string"), F.lit(" of "), F.col("source_file")))
    missing = F.coalesce("_got", F.lit(0)) < F.greatest("_told", F.lit(1))
    refused = layout.where("_torn IS NOT NULL").join(counts, "source_file", "left").select(
        "source_file", F.col("_torn").alias("source_row_number"), F.lit(0).alias("_place"), F.when(missing, told.cast("string")).alias("value"))
    rows = flat.unionByName(spread.withColumn("_place", F.col("_place").cast("int"))).unionByName(refused)
    rows = rows.withColumn("source_feature_number", F.col("_place") + 1).drop("_place").filter(F.contains("value", F.lit('"geometry"')))
    held = F.regexp_extract("value", _PROPERTIES, 1)
    plain = F.regexp_replace(held, _TEXT, "")
    nested = F.regexp_count(plain, F.lit(r"[\{\[]")) > 1
    stop = F.raise_error(F.concat(F.lit("nested property in the feature of line "), F.col("source_row_number").cast("string"), F.lit(" of "), F.col("source_file")))
    rows = rows.withColumn("_held", F.when(nested, stop.cast("string")).otherwise(held))
    out = {p: feature_property(F.col("_held"), p) for p in properties}
    out["geometry"] = F.nullif(F.regexp_extract("value", _GEOMETRY, 1), F.lit(""))
    # the check of the properties holds even where no property is asked for
    rows = rows.where(F.col("_held").isNotNull())
    return rows.withColumns(out).drop("value", "_held")


def classify_rows(df: DataFrame, id_col: str, label_col: str, value_cols: Sequence[str],
                  fixed: Mapping[str, Column] | None = None, name: str = "source_row_kind") -> DataFrame:
    """S-3: title, header and the like by ``fixed`` conditions first, then blank, unit, banner or unclassified."""
    filled = F.filter(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in value_cols]), lambda x: x != "")
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    kind = None
    for label, condition in (fixed or {}).items():
        condition = F.coalesce(condition, F.lit(False))
        kind = F.when(condition, label) if kind is None else kind.when(condition, label)
    blank = ~has(id_col) & ~has(label_col) & (F.size(filled) == 0)
    kind = F.when(blank, "blank") if kind is None else kind.when(blank, "blank")
    return df.withColumn(name, kind.when(has(id_col), "unit").when(has(label_col) & (F.size(filled) == 0), "banner")
                         .otherwise("unclassified"))


def read_landing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """S-5: delivered files with their bytes; Spark reads one file per row, so a delivery stays under its 2 GB limit."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """S-5: one row per distinct content: its hash, first path, size and how many copies were found.

    Only the hash is shuffled, never the bytes.
    """
    hashed = files.select(F.col(path).alias("path"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"),
                          F.octet_length(F.col(content)).cast("bigint").alias("bytes"))
    return hashed.groupBy("sha256").agg(F.min("path").alias("path"), F.max("bytes").alias("bytes"), F.count("*").alias("copies"))


def missing_approved(approved: DataFrame, found: DataFrame, key: str = "sha256") -> DataFrame:
    """S-5: approved deliveries no file was found for."""
    return approved.join(found.select(key), key, "left_anti")
