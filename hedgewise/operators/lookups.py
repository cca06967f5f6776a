"""Statutory lookup tables and the ways rows are matched to them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from hedgewise.functions.scalars import trimmed
from hedgewise.plans import keyed_join, literal_table

AREA, HEDGEROW, WATERCOURSE = "area", "hedgerow", "watercourse"
POOR = "Poor"

HABITAT_SCHEMA = (
    "kind string, name string, band string, score double, "
    "create_difficulty string, enhance_difficulty string"
)
CONDITION_SCHEMA = "kind string, name string, condition string, score double"
YEARS_CREATE_SCHEMA = "kind string, name string, end_condition string, years int"
YEARS_ENHANCE_SCHEMA = (
    "kind string, name_from string, start_condition string, "
    "name_to string, end_condition string, years int"
)
FACTOR_SCHEMA = "name string, multiplier double"
TREE_AREA_SCHEMA = "size string, area_m2 double"

# Distinctiveness band to score, per kind.
BAND_SCORES = {
    AREA: {"V.High": 8.0, "High": 6.0, "Medium": 4.0, "Low": 2.0, "V.Low": 0.0},
    HEDGEROW: {"V.High": 8.0, "High": 6.0, "Medium": 4.0, "Low": 2.0, "V.Low": 1.0},
    WATERCOURSE: {"V.High": 8.0, "High": 6.0, "Medium": 4.0, "Low": 2.0},
}

# Condition to score.
CONDITION_SCORES = {
    "Good": 3.0,
    "Fairly Good": 2.5,
    "Moderate": 2.0,
    "Fairly Poor": 1.5,
    "Poor": 1.0,
    "N/A - Other": 0.0,
    "Condition Assessment N/A": 1.0,
}

# Difficulty band to multiplier.
DIFFICULTY_MULTIPLIERS = {"Low": 1.0, "Medium": 0.67, "High": 0.33, "Very High": 0.1}

# The habitats whose rows are published
# (kind, name, band, difficulty to create, difficulty to enhance); None is not published.
PUBLISHED_HABITATS = [
    (AREA, "Grassland - Modified grassland", "Low", "Low", "Low"),
    (AREA, "Coastal saltmarsh - Saltmarshes and saline reedbeds", "High", "High", "Medium"),
    (AREA, "Heathland and shrub - Hazel scrub", "Medium", "Medium", None),
    (AREA, "Grassland - Lowland calcareous grassland", "High", "High", "High"),
    (AREA, "Grassland - Traditional orchards", "High", "Low", "Medium"),
    (AREA, "Grassland - Other neutral grassland", "Medium", None, "Low"),
    (AREA, "Cropland - Cereal crops", "Low", "Low", None),
    (
        AREA,
        "Intertidal hard structures - Artificial hard structures with integrated greening"
        " of grey infrastructure (IGGI)",
        "V.Low",
        None,
        None,
    ),
    (HEDGEROW, "Native hedgerow", "Low", "Low", "Low"),
    (HEDGEROW, "Non-native and ornamental hedgerow", "V.Low", "Low", "Low"),
    (WATERCOURSE, "Other rivers and streams", "High", "High", "Medium"),
    (WATERCOURSE, "Ditches", "Medium", "Medium", "Low"),
    (WATERCOURSE, "Culvert", "Low", None, None),
]

# Years to create (kind, name, end condition, years); None is "Not Possible".
PUBLISHED_YEARS_CREATE = [
    (AREA, "Grassland - Modified grassland", "Good", 7),
    (AREA, "Coastal saltmarsh - Saltmarshes and saline reedbeds", "Good", 15),
    (AREA, "Coastal saltmarsh - Saltmarshes and saline reedbeds", "Poor", 1),
    (AREA, "Heathland and shrub - Hazel scrub", "Good", 15),
    (AREA, "Grassland - Lowland calcareous grassland", "Good", 20),
    (AREA, "Cropland - Cereal crops", "Condition Assessment N/A", 1),
    (AREA, "Cropland - Cereal crops", "Poor", None),
    (HEDGEROW, "Native hedgerow", "Good", 12),
    (WATERCOURSE, "Other rivers and streams", "Good", 10),
    (WATERCOURSE, "Ditches", "Good", 10),
]

# Years to enhance (kind, from, start condition, to, end condition, years).
PUBLISHED_YEARS_ENHANCE = [
    (AREA, "Grassland - Modified grassland", "Moderate", "Grassland - Modified grassland", "Good", 10),
    (AREA, "Grassland - Modified grassland", "Poor", "Grassland - Other neutral grassland", "Good", 15),
]

# Multiplier when nothing encroaches.
PUBLISHED_ENCROACHMENT = [("No Encroachment", 1.0)]
PUBLISHED_RIPARIAN = [("No Encroachment/No Encroachment", 1.0)]


@dataclass(frozen=True)
class Lookups:
    """The lookup tables pricing needs; every one is an input table."""

    habitat: DataFrame
    condition: DataFrame
    years_create: DataFrame
    years_enhance: DataFrame
    encroachment: DataFrame
    riparian: DataFrame
    tree_area: DataFrame


def published_lookups(spark: SparkSession) -> Lookups:
    """The lookup rows that are published; all others must come from the user's own tables."""
    habitats = [
        (kind, name, band, BAND_SCORES[kind][band], create, enhance)
        for kind, name, band, create, enhance in PUBLISHED_HABITATS
    ]
    graded = ["Good", "Fairly Good", "Moderate", "Fairly Poor", "Poor"]
    conditions = [
        (kind, name, condition, CONDITION_SCORES[condition])
        for kind, name, *_ in PUBLISHED_HABITATS
        for condition in (["Condition Assessment N/A"] if name.startswith("Cropland") else graded)
    ]
    return Lookups(
        habitat=literal_table(spark, HABITAT_SCHEMA, habitats),
        condition=literal_table(spark, CONDITION_SCHEMA, conditions),
        years_create=literal_table(spark, YEARS_CREATE_SCHEMA, PUBLISHED_YEARS_CREATE),
        years_enhance=literal_table(spark, YEARS_ENHANCE_SCHEMA, PUBLISHED_YEARS_ENHANCE),
        encroachment=literal_table(spark, FACTOR_SCHEMA, PUBLISHED_ENCROACHMENT),
        riparian=literal_table(spark, FACTOR_SCHEMA, PUBLISHED_RIPARIAN),
        tree_area=literal_table(spark, TREE_AREA_SCHEMA, []),
    )


def write_lookups(lookups: Lookups, folder: str) -> None:
    """Store the lookup tables where ``read_lookups`` finds them."""
    for field in fields(lookups):
        getattr(lookups, field.name).write.mode("overwrite").parquet(f"{folder}/{field.name}")


def read_lookups(spark: SparkSession, folder: str) -> Lookups:
    """Lookup tables stored as one Parquet table each under ``folder``."""
    schemas = {
        "habitat": HABITAT_SCHEMA,
        "condition": CONDITION_SCHEMA,
        "years_create": YEARS_CREATE_SCHEMA,
        "years_enhance": YEARS_ENHANCE_SCHEMA,
        "encroachment": FACTOR_SCHEMA,
        "riparian": FACTOR_SCHEMA,
        "tree_area": TREE_AREA_SCHEMA,
    }
    return Lookups(
        **{name: spark.read.schema(s).parquet(f"{folder}/{name}") for name, s in schemas.items()}
    )


def difficulty_multiplier(band: Column) -> Column:
    chosen = F.lit(None).cast("double")
    for name, multiplier in DIFFICULTY_MULTIPLIERS.items():
        chosen = F.when(band == name, F.lit(multiplier)).otherwise(chosen)
    return chosen


def habitat_attributes(lookups: Lookups, kind: str) -> DataFrame:
    """One row per baseline habitat of ``kind``."""
    return lookups.habitat.where(F.col("kind") == kind).selectExpr(
        "name AS base_name", "band AS base_band", "score AS base_d"
    )


def target_attributes(lookups: Lookups, kind: str) -> DataFrame:
    """One row per proposed habitat: distinctiveness, difficulty and years to reach poor."""
    to_poor = lookups.years_create.where((F.col("kind") == kind) & (F.col("end_condition") == POOR))
    return (
        lookups.habitat.where(F.col("kind") == kind)
        .join(to_poor.selectExpr("name", "years AS prop_poor_years"), "name", "left")
        .selectExpr(
            "name AS prop_name", "band AS prop_band", "score AS prop_d", "prop_poor_years",
            "create_difficulty", "enhance_difficulty",
        )
        .withColumns(
            {
                "create_factor": difficulty_multiplier(F.col("create_difficulty")),
                "enhance_factor": difficulty_multiplier(F.col("enhance_difficulty")),
            }
        )
    )


def condition_attributes(lookups: Lookups, kind: str) -> DataFrame:
    """One row per condition a baseline habitat can be in, with its score."""
    return lookups.condition.where(F.col("kind") == kind).selectExpr(
        "name AS base_name", "condition AS base_condition", "score AS base_c"
    )


def target_conditions(lookups: Lookups, kind: str) -> DataFrame:
    """One row per condition a proposed habitat can be in: score and years to create it."""
    years = lookups.years_create.where(F.col("kind") == kind).selectExpr(
        "name", "end_condition AS condition", "years AS create_years", "true AS create_listed"
    )
    return (
        lookups.condition.where(F.col("kind") == kind)
        .join(years, ["name", "condition"], "left")
        .selectExpr(
            "name AS prop_name", "condition AS prop_condition", "score AS prop_c",
            "create_years", "create_listed",
        )
    )


def enhancement_years(lookups: Lookups, kind: str) -> DataFrame:
    return lookups.years_enhance.where(F.col("kind") == kind).selectExpr(
        "name_from AS base_name",
        "start_condition AS base_condition",
        "name_to AS prop_name",
        "end_condition AS prop_condition",
        "years AS enhance_years",
        "true AS enhance_listed",
    )


def match_names(names: DataFrame, catalogue: DataFrame, column: str = "name") -> DataFrame:
    """Add ``full_name``: the catalogue's exact name, else its first case-insensitive match.

    ``catalogue`` has ``full_name`` and its position ``cat_no``.
    """
    exact = catalogue.select(F.col("full_name").alias("wanted"), F.col("full_name").alias("exact"))
    folded = (
        catalogue.groupBy(F.lower("full_name").alias("folded"))
        .agg(F.min_by("full_name", "cat_no").alias("by_case"))
    )
    wanted = names.withColumn("wanted", trimmed(F.col(column))).withColumn("folded", F.lower("wanted"))
    matched = keyed_join(keyed_join(wanted, exact.distinct(), ["wanted"]), folded, ["folded"])
    return matched.withColumn("full_name", F.coalesce("exact", "by_case")).drop(
        "wanted", "folded", "exact", "by_case"
    )


SEPARATOR = " - "
MAX_SUGGESTIONS = 5


def suggest_names(
    names: DataFrame, catalogue: DataFrame, column: str = "name", limit: int = MAX_SUGGESTIONS
) -> DataFrame:
    """First ``limit`` near misses in catalogue order for each distinct name.

    A catalogue entry is near when it contains the whole input, begins with its broad
    half, or contains its type half. All three are substring tests, so the catalogue is
    expanded once into (substring, entry) and the tests become equality joins on the
    needles that occur; each needle keeps only its own first ``limit`` entries, which is
    enough because the first ``limit`` of a union are among those of its parts.
    """
    lowered = F.lower(trimmed(F.col(column)))
    at = F.instr("whole", SEPARATOR)
    wanted = (
        names.select(column)
        .where(F.col(column).isNotNull())
        .distinct()
        .withColumn("whole", lowered)
        .withColumn("broad", F.when(at == 0, F.col("whole")).otherwise(F.substring("whole", F.lit(1), at - 1)))
        .withColumn(
            "kind",
            F.when(at > 0, F.substring("whole", at + len(SEPARATOR), F.length("whole"))),
        )
    )
    needles = wanted.select(
        column,
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("at_start"), F.col("whole").alias("needle")),
                F.struct(F.lit(True).alias("at_start"), F.col("broad").alias("needle")),
                F.struct(F.lit(False).alias("at_start"), F.nullif("kind", F.lit("")).alias("needle")),
            )
        ).alias("n"),
    ).select(column, "n.*").where(F.col("needle").isNotNull())

    entry = catalogue.select("cat_no", "full_name", F.lower("full_name").alias("text"))
    starts = F.sequence(F.lit(1), F.length("text"))
    lengths = F.sequence(F.lit(1), F.length("text") - F.col("start") + 1)
    pieces = (
        entry.where(F.length("text") > 0)
        .withColumn("start", F.explode(starts))
        .withColumn("size", F.explode(lengths))
        .select("cat_no", "full_name", "start", F.substring("text", F.col("start"), F.col("size")).alias("needle"))
    )
    inside = pieces.select(F.lit(False).alias("at_start"), "needle", "cat_no", "full_name")
    leading = pieces.where("start = 1").select(F.lit(True).alias("at_start"), "needle", "cat_no", "full_name")
    empty = entry.orderBy("cat_no").limit(limit)
    blank = empty.select(F.lit(False).alias("at_start"), F.lit("").alias("needle"), "cat_no", "full_name")
    blank = blank.unionByName(blank.withColumn("at_start", F.lit(True)))

    key = ["at_start", "needle"]
    used = needles.select(*key).distinct()
    by_needle = Window.partitionBy(*key).orderBy("cat_no")
    index = (
        inside.unionByName(leading)
        .unionByName(blank)
        .join(used, key, "left_semi")
        .groupBy(*key, "cat_no", "full_name")
        .agg(F.lit(1).alias("one"))
        .withColumn("rank", F.row_number().over(by_needle))
        .where(F.col("rank") <= limit)
        .drop("rank", "one")
    )
    by_name = Window.partitionBy(column).orderBy("cat_no")
    return (
        needles.join(index, key)
        .select(column, "cat_no", "full_name")
        .distinct()
        .withColumn("suggestion_no", F.row_number().over(by_name))
        .where(F.col("suggestion_no") <= limit)
        .select(column, "suggestion_no", "full_name")
    )
