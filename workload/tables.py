"""Feature layers derived from the given tables; the lookup values are synthetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewise.functions.scalars import habitat_name, hectares, kilometres, layer_ref
from hedgewise.operators import lookups as lk
from hedgewise.plans import literal_table, numbered

CONDITIONS = ["Good", "Fairly Good", "Moderate", "Fairly Poor", "Poor"]
CONDITION_VALUES = [3.0, 2.5, 2.0, 1.5, 1.0]
AREA_SCORES = [2, 6, 4, 6, 6, 4, 2, 0]
AREA_CREATE = ["Low", "High", "Medium", "High", "Low", "Very High", "Low", "Low"]
AREA_ENHANCE = ["Low", "Medium", "Medium", "High", "Medium", "High", "Low", "Low"]
HEDGE_SCORES = [2, 6, 4, 8, 1, 4]
WATER_SCORES = [2, 4, 6, 8]
WATER_CREATE = ["Low", "Medium", "High", "Very High"]
WATER_ENHANCE = ["Low", "Low", "Medium", "High"]
ENCROACHMENT = [("None", 1.0), ("Minor", 0.8), ("Major", 0.5)]
RIPARIAN = [("None/None", 1.0), ("Minor/None", 0.9), ("Major/Major", 0.6)]
TREE_AREAS = [("Small", 41.0), ("Medium", 163.0), ("Large", 366.0)]
TREE_SIZES = ["Small", "Medium", "Large", "Unlisted"]


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def area_name(index: Column) -> Column:
    return habitat_name(area_broad(index), area_type(index))


def area_broad(index: Column) -> Column:
    return F.concat(F.lit("Broad "), (index % 3).cast("string"))


def area_type(index: Column) -> Column:
    return F.concat(F.lit("Type "), index.cast("string"))


def _sql_array(values: list) -> str:
    return "array(" + ", ".join(f"{v}D" if isinstance(v, (int, float)) else f"'{v}'" for v in values) + ")"


def _kind_rows(spark, kind, name, scores, create, enhance):
    """Lookup rows of one kind, all built by rule over (habitat, condition) numbers.

    ``name`` is SQL text over the habitat number ``{h}``.
    """
    count, pair = len(scores), len(scores) * 5
    bands = [next(b for b, v in lk.BAND_SCORES[kind].items() if v == s) for s in scores]

    def rows(size, *columns):
        return spark.range(0, size, 1, 1).selectExpr("CAST(id AS INT) AS id").selectExpr(
            f"'{kind}' AS kind", *columns
        )

    def of(values, index):
        return f"get({_sql_array(values)}, {index})"

    habitat = rows(
        count,
        f"{name.format(h='id')} AS name",
        f"{of(bands, 'id')} AS band",
        f"{of(scores, 'id')} AS score",
        f"{of(create, 'id')} AS create_difficulty",
        f"{of(enhance, 'id')} AS enhance_difficulty",
    )
    h, c = "CAST(id DIV 5 AS INT)", "id % 5"
    condition = rows(
        pair,
        f"{name.format(h=h)} AS name",
        f"{of(CONDITIONS, c)} AS condition",
        f"{of(CONDITION_VALUES, c)} AS score",
        "id",
    ).where("id <> 5 * 5 + 1").drop("id")
    blocked = f"{h} = 6 AND {c} = 4"
    years_create = rows(
        pair,
        f"{name.format(h=h)} AS name",
        f"{of(CONDITIONS, c)} AS end_condition",
        f"CAST(CASE WHEN NOT ({blocked}) THEN ({h} * 7 + {c} * 5) % 34 END AS INT) AS years",
    )
    h0, c0 = f"CAST(id DIV {5 * pair} AS INT)", f"CAST((id DIV {pair}) % 5 AS INT)"
    h1 = f"CAST((id DIV 5) % {count} AS INT)"
    blocked = f"{h1} = 6 AND {c} = 4"
    years_enhance = rows(
        pair * pair,
        f"{name.format(h=h0)} AS name_from",
        f"{of(CONDITIONS, c0)} AS start_condition",
        f"{name.format(h=h1)} AS name_to",
        f"{of(CONDITIONS, c)} AS end_condition",
        f"CAST(CASE WHEN NOT ({blocked}) THEN ({h0} + {c0} * 3 + {h1} * 7 + {c} * 5) % 34 END AS INT) AS years",
    )
    return habitat, condition, years_create, years_enhance


def numbered_name(prefix: str):
    return lambda index: F.concat(F.lit(prefix), index.cast("string"))


def synthetic_lookups(spark: SparkSession, kind: str = lk.AREA) -> lk.Lookups:
    low = ["Low"] * len(HEDGE_SCORES)
    if kind == lk.AREA:
        name = "concat('Broad ', CAST({h} % 3 AS STRING), ' - Type ', CAST({h} AS STRING))"
        tables = _kind_rows(spark, kind, name, AREA_SCORES, AREA_CREATE, AREA_ENHANCE)
    elif kind == lk.HEDGEROW:
        tables = _kind_rows(spark, kind, "concat('Hedge ', CAST({h} AS STRING))", HEDGE_SCORES, low, low)
    else:
        name = "concat('Water ', CAST({h} AS STRING))"
        tables = _kind_rows(spark, kind, name, WATER_SCORES, WATER_CREATE, WATER_ENHANCE)
    return lk.Lookups(
        *tables,
        encroachment=literal_table(spark, lk.FACTOR_SCHEMA, ENCROACHMENT),
        riparian=literal_table(spark, lk.FACTOR_SCHEMA, RIPARIAN),
        tree_area=literal_table(spark, lk.TREE_AREA_SCHEMA, TREE_AREAS),
    )


def year_texts() -> dict[str, Column]:
    q, whole = F.col("l_quantity"), F.col("l_quantity").cast("int").cast("string")
    opened = (F.col("l_linestatus") == "O") & (q <= 20)
    closed = (F.col("l_linestatus") == "F") & (q <= 20)
    return {
        "advance_raw": F.when(q == 50, "4").when(q == 49, "31").when(q == 48, "5 yrs")
        .when(opened, whole).otherwise(""),
        "delay_raw": F.when(q == 50, "3").when(closed, whole),
    }


def retention_of(flag: Column, gone: str) -> Column:
    return F.when(flag == "R", "Retained").when(flag == "A", "Enhanced").otherwise(gone)


def parcels(spark: SparkSession, folder: str) -> DataFrame:
    """Area parcels: one per line item, without positions."""
    return described(line_items(spark, folder))


def placed_parcels(spark: SparkSession, folder: str) -> DataFrame:
    """The same with ``n``; rows are numbered before they get their texts."""
    return described(placed(line_items(spark, folder)), "n")


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("site_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.col("l_extendedprice").alias("area_m2"), "l_returnflag", "l_linestatus",
    )


def described(rows: DataFrame, *more: str) -> DataFrame:
    base, prop = F.col("l_partkey") % 9, (F.col("l_partkey") + F.col("l_suppkey")) % 9
    return rows.select(
        "site_id", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        layer_ref("habitats", F.col("l_linenumber")).alias("parcel_ref"),
        "area_m2",
        area_broad(base).alias("base_broad"),
        area_type(base).alias("base_type"),
        pick(CONDITIONS, F.col("l_suppkey") % 5).alias("base_condition"),
        area_broad(prop).alias("prop_broad"),
        area_type(prop).alias("prop_type"),
        pick(CONDITIONS, (F.col("l_suppkey") + F.col("l_linenumber")) % 5).alias("prop_condition"),
        retention_of(F.col("l_returnflag"), "Lost").alias("retention"),
        *[c.alias(n) for n, c in year_texts().items()],
        *more,
    )


def placed(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Add ``n``, the parcel's position within its site."""
    return numbered(
        df, ["site_id"], ["l_linenumber", "l_partkey", "l_suppkey", "area_m2"], "n",
        {"line_slice": F.col("l_linenumber"), "part_slice": F.floor(F.col("l_partkey") / 4096)},
    )


def pricing_input(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "size": hectares(F.col("area_m2")),
            "base_name": habitat_name(F.col("base_broad"), F.col("base_type")),
            "prop_name": habitat_name(F.col("prop_broad"), F.col("prop_type")),
        }
    )


def linear_features(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Hedgerows or watercourses: one per line item."""
    count = 7 if kind == lk.HEDGEROW else 5
    name = numbered_name("Hedge " if kind == lk.HEDGEROW else "Water ")
    layer = "hedgerows" if kind == lk.HEDGEROW else "rivers"
    kept = F.when(F.col("l_linenumber") == 7, "Lost").otherwise(
        retention_of(F.col("l_returnflag"), "Created")
    )
    names = [n for n, _ in ENCROACHMENT], [n for n, _ in RIPARIAN]
    return load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("site_id"), "l_linenumber", "l_partkey", "l_suppkey",
        layer_ref(layer, F.col("l_linenumber")).alias("parcel_ref"),
        kilometres(F.col("l_extendedprice")).alias("size"),
        name(F.col("l_partkey") % count).alias("base_name"),
        pick(CONDITIONS, F.col("l_suppkey") % 5).alias("base_condition"),
        name((F.col("l_partkey") + F.col("l_suppkey")) % count).alias("prop_name"),
        pick(CONDITIONS, (F.col("l_suppkey") + F.col("l_linenumber")) % 5).alias("prop_condition"),
        kept.alias("retention"),
        *[c.alias(n) for n, c in year_texts().items()],
        pick(names[0], F.col("l_partkey") % 4).alias("prop_encroachment"),
        pick(names[1], F.col("l_suppkey") % 4).alias("prop_riparian"),
    )


def trees(spark: SparkSession, folder: str) -> DataFrame:
    return (
        pricing_input(parcels(spark, folder))
        .drop("size", "area_m2")
        .withColumns(
            {
                "tree_ref": layer_ref("trees", F.col("l_linenumber")),
                "tree_size": pick(TREE_SIZES, F.col("l_partkey") % 4),
                "retention": F.when(F.col("retention") == "Lost", "Created").otherwise(F.col("retention")),
            }
        )
    )
