"""Validation queries: structure from ``part``, shapes and attributes from ``lineitem``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewise.functions import geometry as g
from hedgewise.operators import attribute_rules as ar
from hedgewise.operators import lookups as lk
from hedgewise.operators import shape_rules as sr
from hedgewise.operators import spatial as sp
from hedgewise.operators import structure_rules as st
from hedgewise.operators import validate as va
from hedgewise.plans import literal_table
from hedgewise.sources import gpkg
from workload import sql as q
from workload import tables as t
from workload.pricing import rounded
from workload.registry import query

TEMPLATE_LAYERS = [
    ("Red Line Boundary", "POLYGON"), ("Habitats", "MULTIPOLYGON"), ("Hedgerows", "LINESTRING"),
    ("Rivers", "LINESTRING"), ("Urban Trees", "POINT"),
]
TEMPLATE_COLUMNS = [
    ("Red Line Boundary", "fid", "INTEGER", True, True), ("Red Line Boundary", "Area", "REAL", False, False),
    ("Habitats", "fid", "INTEGER", True, True), ("Habitats", "Parcel Ref", "TEXT(20)", False, False),
    ("Habitats", "Area", "REAL", False, False), ("Hedgerows", "fid", "INTEGER", True, True),
    ("Rivers", "fid", "INTEGER", True, True), ("Urban Trees", "fid", "INTEGER", True, True),
]
SRID_OF = "CASE WHEN p_size = 1 AND table_name = 'Red Line Boundary' THEN 99999 WHEN p_size = 11 AND table_name = 'Rivers' THEN NULL ELSE 27700 END"


def templates(spark):
    layers = literal_table(spark, "table_name string, geometry_type string", TEMPLATE_LAYERS)
    columns = literal_table(
        spark, "table_name string, column_name string, sqlite_type string, not_null boolean, is_pk boolean",
        TEMPLATE_COLUMNS,
    )
    return layers, columns


def catalogues(spark, folder):
    """One file per part, with faults planted by size and key."""
    part = t.load(spark, folder, "part").select(
        F.col("p_partkey").alias("site_id"), F.lit("baseline").alias("stage"), "p_size"
    )
    key = ["site_id", "stage", "p_size"]
    layers_t, columns_t = templates(spark)
    names = F.array(*[F.struct(F.lit(n).alias("table_name"), F.lit(k).alias("declared")) for n, k in TEMPLATE_LAYERS])
    listed = part.withColumn("l", F.explode(names)).select(*key, "l.*").where(
        "NOT (table_name = 'Habitats' AND site_id % 50 = 0)"
    )
    layers = listed.withColumns(
        {
            "data_type": F.when(
                (F.col("p_size") == 12) & (F.col("table_name") == "Rivers"), "attributes"
            ).otherwise("features"),
            "contents_srs_id": F.expr(SRID_OF).cast("int"),
        }
    )
    extra = part.where("site_id % 41 = 0").select(
        *key, F.lit("iggis").alias("table_name"), F.lit("POLYGON").alias("declared"),
        F.lit("features").alias("data_type"), F.lit(27700).alias("contents_srs_id"),
    )
    layers = layers.unionByName(extra)
    red, hedges = F.col("table_name") == "Red Line Boundary", F.col("table_name") == "Hedgerows"
    geometry = layers.where("NOT (p_size = 7 AND table_name IN ('Habitats', 'Rivers')) AND NOT (p_size = 8 AND table_name = 'Red Line Boundary')").select(
        "site_id", "stage", "table_name",
        F.when((F.col("p_size") == 9) & hedges, "geo m").otherwise("geom").alias("column_name"),
        F.when((F.col("p_size") == 4) & hedges, "POLYGON").otherwise(F.col("declared")).alias("geometry_type"),
        F.when((F.col("p_size") == 2) & red, 4326).otherwise(F.col("contents_srs_id")).alias("srs_id"), "p_size",
    )
    second = geometry.where("p_size = 3 AND table_name = 'Red Line Boundary'").withColumn("column_name", F.lit("geom2"))
    geometry = geometry.unionByName(second).drop("p_size")
    wrong_type = (F.col("p_size") == 6) & (F.col("column_name") == "Area")
    columns = lk.keyed_join(layers.select(*key, "table_name"), columns_t, ["table_name"], "inner").where(
        "NOT (p_size = 5 AND column_name = 'Parcel Ref')"
    ).select(
        "site_id", "stage", "table_name", "column_name",
        F.when(wrong_type, "TEXT").otherwise(F.col("sqlite_type")).alias("sqlite_type"),
        F.when((F.col("p_size") == 13) & (F.col("column_name") == "Area"), True).otherwise(F.col("not_null")).alias("not_null"),
        F.when((F.col("p_size") == 14) & (F.col("table_name") == "Rivers"), False).otherwise(F.col("is_pk")).alias("is_pk"),
    )
    shape_column = layers.where("p_size = 10 AND table_name = 'Rivers'").select(
        "site_id", "stage", "table_name", F.explode(F.array(F.lit("geom"), F.lit("geom2"))).alias("column_name"),
        F.lit("LINESTRING").alias("sqlite_type"), F.lit(False).alias("not_null"), F.lit(False).alias("is_pk"),
    )
    columns = columns.unionByName(shape_column)
    system = F.array(*[F.lit(n) for n in st.SYSTEM_TABLES])
    tables = part.withColumn("table_name", F.explode(system)).where(
        "NOT (p_size = 15 AND table_name = 'gpkg_spatial_ref_sys')"
    ).select("site_id", "stage", "table_name")
    return part, tables, layers.drop("p_size", "declared"), geometry, columns, layers_t, columns_t


_LAYERS_SQL = ", ".join(f"('{n}', '{k}')" for n, k in TEMPLATE_LAYERS)
_COLUMNS_SQL = ", ".join(f"('{a}', '{b}', '{c}', {str(d).lower()}, {str(e).lower()})" for a, b, c, d, e in TEMPLATE_COLUMNS)

CATALOGUES = f"""
WITH tl(table_name, declared) AS (VALUES {_LAYERS_SQL}),
tc(table_name, column_name, sqlite_type, not_null, is_pk) AS (VALUES {_COLUMNS_SQL}),
part0 AS (SELECT p_partkey AS site_id, p_size FROM part),
layers AS (
  SELECT site_id, p_size, table_name, declared,
    CASE WHEN p_size = 12 AND table_name = 'Rivers' THEN 'attributes' ELSE 'features' END AS data_type,
    {SRID_OF} AS contents_srs_id
  FROM part0 CROSS JOIN tl WHERE NOT (table_name = 'Habitats' AND site_id % 50 = 0)
  UNION ALL SELECT site_id, p_size, 'iggis', 'POLYGON', 'features', 27700 FROM part0 WHERE site_id % 41 = 0),
geometry0 AS (
  SELECT site_id, p_size, table_name,
    CASE WHEN p_size = 9 AND table_name = 'Hedgerows' THEN 'geo m' ELSE 'geom' END AS column_name,
    CASE WHEN p_size = 4 AND table_name = 'Hedgerows' THEN 'POLYGON' ELSE declared END AS geometry_type,
    CASE WHEN p_size = 2 AND table_name = 'Red Line Boundary' THEN 4326 ELSE contents_srs_id END AS srs_id
  FROM layers WHERE NOT (p_size = 7 AND table_name IN ('Habitats', 'Rivers'))
    AND NOT (p_size = 8 AND table_name = 'Red Line Boundary')),
geometry1 AS (SELECT * FROM geometry0 UNION ALL
  SELECT site_id, p_size, table_name, 'geom2', geometry_type, srs_id FROM geometry0
  WHERE p_size = 3 AND table_name = 'Red Line Boundary'),
columns1 AS (
  SELECT site_id, l.table_name, column_name,
    CASE WHEN p_size = 6 AND column_name = 'Area' THEN 'TEXT' ELSE sqlite_type END AS sqlite_type,
    CASE WHEN p_size = 13 AND column_name = 'Area' THEN true ELSE not_null END AS not_null,
    CASE WHEN p_size = 14 AND l.table_name = 'Rivers' THEN false ELSE is_pk END AS is_pk
  FROM layers l JOIN tc ON tc.table_name = l.table_name WHERE NOT (p_size = 5 AND column_name = 'Parcel Ref')),
vector AS (SELECT * FROM layers WHERE data_type = 'features'),
structural AS (
  SELECT site_id, 'format' AS "group", 'GPKG_MISSING_SYSTEM_TABLE' AS code, 'gpkg_spatial_ref_sys' AS layer,
    CAST(NULL AS VARCHAR) AS detail FROM part0 WHERE p_size = 15
  UNION ALL SELECT site_id, 'layers', 'GPKG_MISSING_LAYER', 'Habitats', NULL FROM part0 WHERE site_id % 50 = 0
  UNION ALL SELECT site_id, 'layers', 'GPKG_UNEXPECTED_FEATURE_LAYER', table_name, NULL FROM vector
    WHERE table_name NOT IN (SELECT table_name FROM tl)
  UNION ALL SELECT site_id, 'crs', 'GPKG_BASELINE_SRS_ID', table_name, CAST(contents_srs_id AS VARCHAR) FROM vector
    WHERE coalesce(contents_srs_id, -1) <> 27700
  UNION ALL SELECT v.site_id, 'crs', 'GPKG_BASELINE_GPKG_SRS_INCONSISTENT', v.table_name, CAST(srs_id AS VARCHAR)
    FROM vector v JOIN geometry1 g ON g.site_id = v.site_id AND g.table_name = v.table_name WHERE srs_id <> contents_srs_id
  UNION ALL SELECT site_id, 'geometry_registration', 'GPKG_BASELINE_CONTENTS_DATA_TYPE', table_name, data_type
    FROM layers WHERE data_type <> 'features'
  UNION ALL SELECT v.site_id, 'geometry_registration', 'GPKG_BASELINE_INVALID_GEOMETRY_COLUMN_NAME', v.table_name, column_name
    FROM vector v JOIN geometry1 g ON g.site_id = v.site_id AND g.table_name = v.table_name
    WHERE NOT regexp_full_match(column_name, '[A-Za-z0-9_]+') AND v.table_name <> 'iggis'
  UNION ALL SELECT site_id, 'geometry_registration', 'GPKG_BASELINE_MULTIPLE_GEOMETRY_COLUMNS', table_name, '2'
    FROM vector WHERE (p_size = 3 AND table_name = 'Red Line Boundary') OR (p_size = 10 AND table_name = 'Rivers')
  UNION ALL SELECT v.site_id, 'geometry_registration', 'GPKG_BASELINE_GEOMETRY_TYPE_NAME', v.table_name, geometry_type
    FROM vector v JOIN geometry1 g ON g.site_id = v.site_id AND g.table_name = v.table_name
    JOIN tl ON tl.table_name = v.table_name WHERE geometry_type <> tl.declared
  UNION ALL SELECT v.site_id, 'geometry_registration', CASE v.table_name WHEN 'Habitats' THEN 'GPKG_HABITATS_NO_GEOMETRY_COLUMN'
      WHEN 'Red Line Boundary' THEN 'GPKG_RLB_NO_GEOMETRY_COLUMN' ELSE 'GPKG_BASELINE_GEOMETRY_REGISTRATION_MISSING' END,
      v.table_name, NULL
    FROM vector v JOIN tl ON tl.table_name = v.table_name
    WHERE NOT EXISTS (SELECT 1 FROM geometry1 g WHERE g.site_id = v.site_id AND g.table_name = v.table_name)
  UNION ALL SELECT site_id, 'columns', 'GPKG_BASELINE_MISSING_COLUMN', table_name, 'Parcel Ref' FROM vector
    WHERE p_size = 5 AND table_name = 'Habitats'
  UNION ALL SELECT c.site_id, 'columns', 'GPKG_BASELINE_COLUMN_SQLITE_TYPE', c.table_name, c.column_name
    FROM columns1 c JOIN tc ON tc.table_name = c.table_name AND tc.column_name = c.column_name WHERE tc.sqlite_type <> c.sqlite_type
  UNION ALL SELECT c.site_id, 'columns', 'GPKG_BASELINE_COLUMN_NOT_NULL', c.table_name, c.column_name
    FROM columns1 c JOIN tc ON tc.table_name = c.table_name AND tc.column_name = c.column_name WHERE tc.not_null <> c.not_null
  UNION ALL SELECT c.site_id, 'columns', 'GPKG_BASELINE_COLUMN_PRIMARY_KEY', c.table_name, c.column_name
    FROM columns1 c JOIN tc ON tc.table_name = c.table_name AND tc.column_name = c.column_name
    JOIN vector v ON v.site_id = c.site_id AND v.table_name = c.table_name WHERE tc.is_pk <> c.is_pk)"""


@query("structure_violations", f'{CATALOGUES} SELECT site_id, "group", code, layer, detail FROM structural')
def structure_violations(spark, folder):
    found = st.structure_rules(*catalogues(spark, folder))
    return found.select("site_id", "group", "code", "layer", "detail")


_RULES_SQL = ", ".join(f"('{g_}', '{c}')" for g_, codes in va.RULES.items() for c in codes)


@query(
    "rule_hits",
    f"""{CATALOGUES}, rules(g, code) AS (VALUES {_RULES_SQL})
SELECT r.g AS "group", r.code, count(s.code) AS violations, count(DISTINCT s.site_id) AS sites
FROM rules r LEFT JOIN structural s ON s.code = r.code GROUP BY 1, 2""",
)
def rule_hits(spark, folder):
    return va.rule_hits(st.structure_rules(*catalogues(spark, folder)), va.rule_table(spark))


@query(
    "first_failing_group",
    f"""{CATALOGUES}, ranked AS (SELECT site_id, min(CASE "group" WHEN 'format' THEN 1 WHEN 'layers' THEN 2
  WHEN 'crs' THEN 3 WHEN 'geometry_registration' THEN 4 ELSE 5 END) AS stage_no FROM structural GROUP BY 1)
SELECT site_id, stage_no, (['format','layers','crs','geometry_registration','columns'])[stage_no] AS "group" FROM ranked""",
)
def first_failing_group(spark, folder):
    found = va.first_failures(st.structure_rules(*catalogues(spark, folder)), va.rule_table(spark))
    return found.select("site_id", "stage_no", "group")


# -- shapes -------------------------------------------------------------------------


def boxes(spark, folder):
    """Parcels as boxes side by side, some reaching into the next or out of the site."""
    rows = t.placed(t.parcels(spark, folder)).withColumn("stage", F.lit("baseline"))
    x0 = (F.col("n") - 1) * 100.0
    x1 = F.col("n") * 100.0 + F.when(F.col("l_quantity") % 10 == 0, 1.0).otherwise(0.0)
    return rows.select(
        "site_id", "stage", F.lit("Habitats").alias("layer"), F.col("n").alias("feature_id"),
        F.col("parcel_ref").alias("feature_ref"), g.box_wkb(x0, F.lit(0.0), x1, F.lit(50.0)).alias("geometry"),
        "n", "l_quantity", "l_linenumber",
    )


def site_lines(spark, folder):
    counts = t.load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("site_id")).agg(
        F.count(F.lit(1)).alias("parcels")
    )
    return counts.select(
        "site_id", F.lit("baseline").alias("stage"), F.lit("Red Line Boundary").alias("layer"),
        F.lit(1).cast("long").alias("feature_id"), F.lit(None).cast("string").alias("feature_ref"),
        g.box_wkb(F.lit(0.0), F.lit(0.0), F.col("parcels") * 100.0, F.lit(50.0)).alias("geometry"), "parcels",
    )


def hedge_lines(spark, folder):
    rows = boxes(spark, folder)
    x0 = (F.col("n") - 1) * 100.0
    return rows.withColumns(
        {
            "layer": F.lit("Hedgerows"),
            "geometry": g.line_wkb(x0, F.lit(25.0), F.col("n") * 100.0 + F.col("l_linenumber") - 4.0, F.lit(25.0)),
        }
    )


def tree_points(spark, folder):
    return boxes(spark, folder).withColumns(
        {
            "layer": F.lit("Urban Trees"),
            "geometry": g.point_wkb(F.col("n") * 100.0 - 50.0, F.col("l_quantity") + 1.0),
        }
    )


RECTANGLES = f"""
WITH {q.PARCELS},
box AS (SELECT site_id, n, parcel_ref, l_quantity, l_linenumber, (n - 1) * 100.0 AS x0,
  n * 100.0 + CASE WHEN l_quantity % 10 = 0 THEN 1.0 ELSE 0.0 END AS x1 FROM parcels),
site AS (SELECT site_id, count(*) AS parcels, count(*) * 100.0 AS w FROM box GROUP BY 1),
escape AS (SELECT b.site_id, b.n, b.parcel_ref, greatest(0.0, x1 - w) * 50.0 AS outside
  FROM box b JOIN site s ON s.site_id = b.site_id),
hedge AS (SELECT b.site_id, greatest(0.0, n * 100.0 + l_linenumber - 4.0 - w) AS outside
  FROM box b JOIN site s ON s.site_id = b.site_id)"""


@query(
    "parcel_overlaps",
    f"""{RECTANGLES}
SELECT a.site_id, a.parcel_ref AS ref_a, b.parcel_ref AS ref_b, a.n AS id_a, b.n AS id_b, 50.0::DOUBLE AS overlap_m2
FROM box a JOIN box b ON b.site_id = a.site_id AND b.n = a.n + 1 WHERE a.x1 > b.x0""",
)
def parcel_overlaps(spark, folder):
    pairs = sp.overlapping_pairs(sr.with_facts(boxes(spark, folder)))
    return pairs.select("site_id", "ref_a", "ref_b", "id_a", "id_b", rounded("overlap_m2", 3).alias("overlap_m2"))


@query(
    "parcels_outside_redline",
    f"{RECTANGLES} SELECT site_id, n AS feature_id, parcel_ref AS feature_ref, outside::DOUBLE AS outside_m2 FROM escape WHERE outside > 0.5",
)
def parcels_outside(spark, folder):
    out = sp.escaping_areas(sr.with_facts(boxes(spark, folder)), sr.with_facts(site_lines(spark, folder)))
    return out.where("outside_m2 > 0.5").select(
        "site_id", "feature_id", "feature_ref", rounded("outside_m2", 3).alias("outside_m2")
    )


@query(
    "slivers_outside_redline",
    f"""{RECTANGLES} SELECT site_id, 'SLIVERS_OUTSIDE_REDLINE' AS code, printf('%.2f m2', sum(outside)::DOUBLE) AS total
FROM escape GROUP BY site_id HAVING sum(outside) > 0.5""",
)
def slivers(spark, folder):
    found = sp.sliver_rule(sr.with_facts(boxes(spark, folder)), sr.with_facts(site_lines(spark, folder)))
    return found.select("site_id", "code", F.regexp_extract("detail", "^[0-9.]+ m2", 0).alias("total"))


@query(
    "hedgerows_outside_redline",
    f"""{RECTANGLES} SELECT site_id, 'HEDGEROWS_OUTSIDE_REDLINE' AS code, printf('%.2f m', sum(outside)::DOUBLE) AS detail
FROM hedge GROUP BY site_id HAVING sum(outside) > 0.1""",
)
def hedgerows_outside(spark, folder):
    found = sp.outside_length_rule(
        sr.with_facts(hedge_lines(spark, folder)), sr.with_facts(site_lines(spark, folder)),
        "HEDGEROWS_OUTSIDE_REDLINE", "Hedgerows",
    )
    return found.select("site_id", "code", "detail")


@query(
    "trees_outside_redline",
    f"""{RECTANGLES} SELECT site_id, parcel_ref AS feature_ref, '1.00 m' AS detail FROM box WHERE l_quantity = 50""",
)
def trees_outside(spark, folder):
    found = sp.outside_point_rule(sr.with_facts(tree_points(spark, folder)), sr.with_facts(site_lines(spark, folder)))
    return found.select("site_id", "feature_ref", "detail")


@query(
    "area_sum_mismatch",
    f"""{RECTANGLES} SELECT b.site_id, printf('parcels %.2f m2, boundary %.2f m2', (sum(x1 - x0) * 50)::DOUBLE, (max(w) * 50)::DOUBLE) AS detail
FROM box b JOIN site s ON s.site_id = b.site_id GROUP BY b.site_id HAVING abs(sum(x1 - x0) * 50 - max(w) * 50) > 0.5""",
)
def area_sum(spark, folder):
    found = sp.area_sum_rule(sr.with_facts(boxes(spark, folder)), sr.with_facts(site_lines(spark, folder)))
    return found.select("site_id", "detail")


@query(
    "redline_outside_outline",
    f"{RECTANGLES} SELECT site_id, printf('%.2f m2', ((w - 450.0) * 50)::DOUBLE) AS detail FROM site WHERE w > 450.01",
)
def redline_outside_outline(spark, folder):
    lines = sr.with_facts(site_lines(spark, folder))
    outline = spark.range(1).select(
        F.lit("England").alias("outline"),
        g.box_wkb(F.lit(-10.0), F.lit(-10.0), F.lit(450.0), F.lit(1000.0)).alias("geometry"),
    )
    return sp.outline_rule(lines, outline).select("site_id", "detail")


@query(
    "implausible_sizes",
    """SELECT l_orderkey AS site_id, CASE WHEN l_linenumber = 1 THEN 'REDLINE_AREA_TOO_LARGE' ELSE 'AREA_PARCELS_TOO_SMALL' END AS code,
  l_linenumber AS line, l_partkey, l_suppkey FROM lineitem
WHERE (l_linenumber = 1 AND l_extendedprice * 2000.0 > 100000000.0) OR (l_linenumber <> 1 AND l_extendedprice / 10000.0 < 1.0)""",
)
def implausible_sizes(spark, folder):
    rows = t.load(spark, folder, "lineitem")
    first = F.col("l_linenumber") == 1
    width = F.when(first, F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") / 10000.0)
    features = sr.with_facts(
        rows.select(
            F.col("l_orderkey").alias("site_id"), F.lit("baseline").alias("stage"),
            F.when(first, "Red Line Boundary").otherwise("Habitats").alias("layer"),
            F.concat_ws(":", "l_linenumber", "l_partkey", "l_suppkey").alias("feature_ref"),
            g.box_wkb(F.lit(0.0), F.lit(0.0), width, F.when(first, 2000.0).otherwise(1.0)).alias("geometry"),
        )
    )
    parts = F.split("feature_ref", ":")
    return sp.size_rules(features).select(
        "site_id", "code", F.get(parts, 0).cast("int").alias("line"),
        F.get(parts, 1).cast("long").alias("l_partkey"), F.get(parts, 2).cast("long").alias("l_suppkey"),
    )


def mixed_features(spark, folder) -> DataFrame:
    """Features of four layers with missing, stray and unreadable shapes planted by site."""
    rows = boxes(spark, folder)
    site, n = F.col("site_id"), F.col("n")
    point = g.point_wkb(n * 100.0, F.lit(1.0))
    broken = F.lit(b"\x01\x03\x00").cast("binary")
    habitats = rows.withColumn(
        "geometry",
        F.when(site % 29 == 0, point)
        .when((site % 31 == 0) & (n == 1), broken)
        .when((site % 37 == 0) & (n == 2), point)
        .otherwise(F.col("geometry")),
    )
    lines = hedge_lines(spark, folder).withColumn(
        "geometry",
        F.when(site % 41 == 0, F.lit(None).cast("binary"))
        .when((site % 43 == 0) & (n == 2), point)
        .when((site % 47 == 0) & (n == 1), broken)
        .otherwise(F.col("geometry")),
    )
    outline = site_lines(spark, folder).where("site_id % 53 <> 0")
    copies = F.when(site % 59 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    outline = outline.withColumn("copy", F.explode(copies)).withColumn(
        "geometry", F.when(site % 61 == 0, g.point_wkb(F.lit(0.0), F.lit(0.0))).otherwise(F.col("geometry"))
    )
    columns = ["site_id", "stage", "layer", "feature_id", "feature_ref", "geometry"]
    return (
        habitats.select(*columns).unionByName(lines.select(*columns)).unionByName(outline.select(*columns))
    )


SHAPE_SQL = f"""
WITH {q.PARCELS},
h AS (SELECT site_id, count(*) AS k, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2 FROM parcels GROUP BY 1),
hits AS (
  SELECT site_id, 'NO_REDLINE' AS code, 'Red Line Boundary' AS layer FROM h WHERE site_id % 53 = 0
  UNION ALL SELECT site_id, 'GPKG_RLB_NO_POLYGON', 'Red Line Boundary' FROM h WHERE site_id % 53 = 0 OR site_id % 61 = 0
  UNION ALL SELECT site_id, 'GPKG_RLB_TOO_MANY_POLYGONS', 'Red Line Boundary' FROM h WHERE site_id % 59 = 0 AND site_id % 53 <> 0
  UNION ALL SELECT site_id, 'NO_HABITAT_AREAS', 'Habitats' FROM h WHERE site_id % 29 = 0
  UNION ALL SELECT site_id, 'GPKG_HABITATS_WRONG_GEOMETRY_TYPE', 'Habitats' FROM h
    WHERE site_id % 29 <> 0 AND site_id % 31 <> 0 AND site_id % 37 = 0 AND k > 1
  UNION ALL SELECT site_id, 'GPKG_HABITATS_UNREADABLE_GEOMETRY', 'Habitats' FROM h WHERE site_id % 31 = 0 AND site_id % 29 <> 0
  UNION ALL SELECT site_id, 'GPKG_HEDGEROWS_NO_LINESTRING_GEOMETRY', 'Hedgerows' FROM h WHERE site_id % 41 = 0
  UNION ALL SELECT site_id, 'GPKG_HEDGEROWS_WRONG_GEOMETRY_TYPE', 'Hedgerows' FROM h
    WHERE site_id % 41 <> 0 AND site_id % 43 = 0 AND site_id % 47 <> 0 AND k > 1
  UNION ALL SELECT site_id, 'GPKG_HEDGEROWS_UNREADABLE_GEOMETRY', 'Hedgerows' FROM h WHERE site_id % 47 = 0 AND site_id % 41 <> 0)
SELECT * FROM hits"""


@query("shape_violations", SHAPE_SQL)
def shape_violations(spark, folder):
    sites = site_lines(spark, folder).select("site_id", "stage")
    found = sr.shape_rules(sites, sr.with_facts(mixed_features(spark, folder)))
    return found.select("site_id", "code", "layer")


@query(
    "illegal_shapes",
    f"""WITH {q.PARCELS}, bad AS (SELECT site_id, parcel_ref, n,
  row_number() OVER (PARTITION BY site_id ORDER BY parcel_ref, n) AS nth FROM parcels WHERE l_quantity % 3 = 0)
SELECT site_id, 'AREA_PARCELS_INVALID_GEOMETRY' AS code, parcel_ref AS feature_ref FROM bad WHERE nth <= 50""",
)
def illegal_shapes(spark, folder):
    rows = boxes(spark, folder)
    x0, x1 = (F.col("n") - 1) * 100.0, F.col("n") * 100.0
    bow = F.concat(
        F.lit(bytes.fromhex("01030000000100000005000000")),
        *[F.substring(g.point_wkb(x, F.lit(y)), 6, 16) for x, y in ((x0, 0.0), (x1, 50.0), (x1, 0.0), (x0, 50.0), (x0, 0.0))],
    )
    shaped = rows.withColumn("geometry", F.when(F.col("l_quantity") % 3 == 0, bow).otherwise(F.col("geometry")))
    found = sr.reported(sr.legal_shape_rules(sr.with_facts(shaped)), per_code=50)
    return found.select("site_id", "code", "feature_ref")


@query(
    "native_measures",
    """SELECT l_orderkey AS site_id, l_linenumber, l_partkey, l_suppkey,
  floor((l_quantity * l_linenumber - 0.5 * l_quantity * 1.0) * 1e3 + 0.5) / 1e3 AS area_m2,
  floor((sqrt(l_quantity * l_quantity + 1.0) + l_linenumber) * 1e3 + 0.5) / 1e3 AS length_m FROM lineitem""",
)
def native_measures(spark, folder):
    rows = t.load(spark, folder, "lineitem")
    w, h = F.col("l_quantity"), F.col("l_linenumber").cast("double")

    def point(x, y):
        return F.struct(F.lit(x).cast("double").alias("x") if isinstance(x, float) else x.alias("x"),
                        F.lit(y).cast("double").alias("y") if isinstance(y, float) else y.alias("y"))

    # A box whose top edge dips to a vertex one metre lower in the middle.
    ring = F.array(point(0.0, 0.0), point(w, 0.0), point(w, h), point(w / 2, h - 1.0), point(0.0, h), point(0.0, 0.0))
    path = F.array(point(0.0, 0.0), point(w, 1.0), point(w, h + 1.0))
    return rows.select(
        F.col("l_orderkey").alias("site_id"), "l_linenumber", "l_partkey", "l_suppkey",
        rounded(g.ring_area(ring), 3).alias("area_m2"), rounded(g.path_length(path), 3).alias("length_m"),
    )


def at(x, y) -> Column:
    """A place with x and y."""
    return F.struct(*[(c if isinstance(c, Column) else F.lit(float(c))).cast("double").alias(n) for n, c in (("x", x), ("y", y))])


@query(
    "multipart_measures",
    """SELECT l_orderkey AS site_id, l_linenumber, l_partkey, l_suppkey,
  floor((l_quantity * 10.0 - 0.5 * 2.0 + l_quantity * l_linenumber / 2.0) * 1e3 + 0.5) / 1e3 AS area_m2,
  floor((sqrt(l_quantity * l_quantity + 1.0) + l_linenumber + sqrt(l_quantity * l_quantity + 9.0)) * 1e3 + 0.5) / 1e3 AS length_m
FROM lineitem""",
)
def multipart_measures(spark, folder):
    """A MULTIPOLYGON with a hole, and a MULTILINESTRING, measured from coordinate arrays without leaving the JVM."""
    w, h = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    box = F.array(at(0, 0), at(w, 0), at(w, 10), at(0, 10), at(0, 0))
    hole = F.array(at(0.25, 5), at(0.75, 5), at(0.75, 7), at(0.25, 7), at(0.25, 5))
    triangle = F.array(at(100, 0), at(w + 100, 0), at(100, h), at(100, 0))
    parts = F.array(F.array(box, hole), F.array(triangle))
    paths = F.array(F.array(at(0, 0), at(w, 1), at(w, h + 1)), F.array(at(5, 5), at(w + 5, 8)))
    return t.load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("site_id"), "l_linenumber", "l_partkey", "l_suppkey",
        rounded(g.multipolygon_area(parts), 3).alias("area_m2"), rounded(g.multipath_length(paths), 3).alias("length_m"),
    )


# -- attributes ------------------------------------------------------------------------


def attributed(spark, folder) -> DataFrame:
    rows = t.pricing_input(t.parcels(spark, folder))
    return rows.select(
        "site_id", F.lit("baseline").alias("stage"), F.lit("Habitats").alias("layer"),
        F.col("parcel_ref").alias("feature_ref"), F.lit(lk.AREA).alias("kind"),
        "base_name", "prop_name", "advance_raw", "delay_raw",
    )


@query(
    "distinctiveness_out_of_scope",
    f"""WITH {q.PARCELS}, {q.AREA_LOOKUPS}
SELECT site_id, parcel_ref AS feature_ref, 'existing ' || name || ' ' || band AS detail FROM parcels
JOIN hab ON name = base_broad || ' - ' || base_type WHERE band IN ('High', 'V.High')
UNION ALL SELECT site_id, parcel_ref, 'proposed ' || name || ' ' || band FROM parcels
JOIN hab ON name = prop_broad || ' - ' || prop_type WHERE band IN ('High', 'V.High')""",
)
def out_of_scope(spark, folder):
    found = ar.scope_rule(attributed(spark, folder), t.synthetic_lookups(spark).habitat)
    return found.select("site_id", "feature_ref", "detail")


@query(
    "duplicate_refs",
    f"WITH {q.PARCELS} SELECT site_id, parcel_ref AS feature_ref, count(*) AS rows FROM parcels GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_refs(spark, folder):
    return ar.duplicate_refs(attributed(spark, folder)).select("site_id", "feature_ref", "rows")


@query(
    "advance_and_delay_both_set",
    f"WITH {q.PARCELS} SELECT site_id, parcel_ref AS feature_ref, 'advance 4, delay 3' AS detail FROM parcels WHERE l_quantity = 50",
)
def both_set(spark, folder):
    return ar.shift_rule(attributed(spark, folder)).select("site_id", "feature_ref", "detail")


def submission(spark, folder) -> va.Submission:
    """A whole submission per site, structurally sound but for every 41st site's extra layer."""
    columns = ["site_id", "stage", "layer", "feature_id", "feature_ref", "geometry"]
    layers_t, columns_t = templates(spark)
    sites = site_lines(spark, folder).select("site_id", "stage")
    names = F.array(*[F.lit(n) for n, _ in TEMPLATE_LAYERS])
    listed = sites.withColumn("table_name", F.explode(names)).withColumns(
        {"data_type": F.lit("features"), "contents_srs_id": F.lit(27700)}
    )
    extra = sites.where("site_id % 41 = 0").withColumns(
        {"table_name": F.lit("iggis"), "data_type": F.lit("features"), "contents_srs_id": F.lit(27700)}
    )
    layers = listed.unionByName(extra)
    geometry = lk.keyed_join(listed, layers_t, ["table_name"], "inner").select(
        "site_id", "stage", "table_name", F.lit("geom").alias("column_name"), "geometry_type", F.lit(27700).alias("srs_id")
    )
    columns_of = lk.keyed_join(listed, columns_t, ["table_name"], "inner").select(
        "site_id", "stage", "table_name", "column_name", "sqlite_type", "not_null", "is_pk"
    )
    tables = sites.withColumn("table_name", F.explode(F.array(*[F.lit(n) for n in st.SYSTEM_TABLES])))
    rows = t.pricing_input(t.placed_parcels(spark, folder))
    n = F.col("n")
    x0, x1 = (n - 1) * 100.0, n * 100.0
    reach = F.when(F.col("l_quantity") % 10 == 0, 1.0).otherwise(0.0)
    shapes = rows.withColumns(
        {
            "box": g.box_wkb(x0, F.lit(0.0), x1 + reach, F.lit(50.0)),
            "line": g.line_wkb(x0, F.lit(25.0), x1 + F.col("l_linenumber") - 4.0, F.lit(25.0)),
            "dot": g.point_wkb(x1 - 50.0, F.col("l_quantity") + 1.0),
        }
    )

    def layer(name: str, shape: str) -> Column:
        return F.struct(F.lit(name).alias("layer"), F.col(shape).alias("geometry"))

    layered = F.array(layer("Habitats", "box"), layer("Hedgerows", "line"), layer("Urban Trees", "dot"))
    texts = ("base_name", "prop_name", "advance_raw", "delay_raw")
    parcel = F.col("layer") == "Habitats"
    features = shapes.withColumn("l", F.explode(layered)).select(
        "site_id", F.lit("baseline").alias("stage"), "l.layer", n.alias("feature_id"),
        F.col("parcel_ref").alias("feature_ref"), "l.geometry", *texts,
    ).withColumns({c: F.when(parcel, F.col(c)) for c in texts})
    outline = site_lines(spark, folder).select(*columns).withColumns({c: F.lit(None).cast("string") for c in texts})
    features = features.unionByName(outline).withColumn(
        "habitat_kind", F.when(F.col("layer") == "Habitats", lk.AREA).otherwise("tree")
    )
    return va.Submission(
        sites, tables, layers, geometry, columns_of, features, layers_t, columns_t,
        t.synthetic_lookups(spark).habitat,
    )


@query(
    "validate_submissions",
    f"""{RECTANGLES}, {q.AREA_LOOKUPS}, gated AS (SELECT site_id FROM site WHERE site_id % 41 = 0),
ok AS (SELECT * FROM parcels WHERE site_id % 41 <> 0),
named AS (SELECT site_id, base_broad || ' - ' || base_type AS name FROM ok
  UNION ALL SELECT site_id, prop_broad || ' - ' || prop_type FROM ok),
hits AS (
  SELECT site_id, 'GPKG_UNEXPECTED_FEATURE_LAYER' AS code, count(*) AS violations FROM gated GROUP BY 1
  UNION ALL SELECT site_id, 'HABITAT_DISTINCTIVENESS_NOT_IN_SCOPE', count(*) FROM named JOIN hab ON hab.name = named.name
    WHERE band IN ('High', 'V.High') GROUP BY 1
  UNION ALL SELECT site_id, 'DUPLICATE_HABITAT_REF', count(*) FROM
    (SELECT site_id, parcel_ref FROM ok GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT site_id, 'ADVANCE_AND_DELAY_BOTH_SET', count(*) FROM ok WHERE l_quantity = 50 GROUP BY 1
  UNION ALL SELECT a.site_id, 'PARCEL_OVERLAPS', count(*) FROM box a JOIN box b ON b.site_id = a.site_id AND b.n = a.n + 1
    WHERE a.x1 > b.x0 GROUP BY 1
  UNION ALL SELECT site_id, 'SLIVERS_OUTSIDE_REDLINE', 1 FROM escape GROUP BY site_id HAVING sum(outside) > 0.5
  UNION ALL SELECT site_id, 'AREA_PARCELS_OUTSIDE_REDLINE', count(*) FROM escape WHERE outside > 0.5 GROUP BY 1
  UNION ALL SELECT site_id, 'HEDGEROWS_OUTSIDE_REDLINE', 1 FROM hedge GROUP BY site_id HAVING sum(outside) > 0.1
  UNION ALL SELECT site_id, 'TREES_OUTSIDE_REDLINE', count(*) FROM box WHERE l_quantity = 50 GROUP BY 1
  UNION ALL SELECT b.site_id, 'AREA_SUM_MISMATCH', 1 FROM box b JOIN site s ON s.site_id = b.site_id
    GROUP BY b.site_id HAVING abs(sum(x1 - x0) * 50 - max(w) * 50) > 0.5)
SELECT site_id, code, CAST(violations AS BIGINT) AS violations FROM hits
WHERE site_id % 41 <> 0 OR code = 'GPKG_UNEXPECTED_FEATURE_LAYER'""",
)
def validate_submissions(spark, folder):
    found = va.validate(submission(spark, folder))
    return found.groupBy("site_id", "code").agg(F.count(F.lit(1)).alias("violations"))


def roofed(width: Column) -> Column:
    """The ring of a boundary with a low roof over its whole width."""
    return F.array(at(0, 0), at(width, 0), at(width, 50), at(width / 2, 60), at(0, 50), at(0, 0))


def every_layer(spark, folder) -> va.Submission:
    """Submissions in the template's own types (parcels of two parts under a roofed boundary), with rivers, hard structures, an
    outline, and faults of files, boundaries, parcels and lines planted by site."""
    base = submission(spark, folder)
    sites = base.sites
    rows = t.placed(t.parcels(spark, folder))
    counts = t.load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("site_id")).agg((F.count(F.lit(1)) * 100.0).alias("w"))
    site, n = F.col("site_id"), F.col("n")
    x0, x1 = (n - 1) * 100.0, n * 100.0
    end = x1 + F.when(F.col("l_quantity") % 10 == 0, 1.0).otherwise(0.0)
    lower = F.array(at(x0, 0), at(x1, 0), at(x0, 50), at(x0, 0))
    upper = F.array(at(x1, 0), at(end, 0), at(end, 50), at(x0, 50), at(x1, 0))
    upper = F.when(end == x1, F.array(at(x1, 0), at(x1, 50), at(x0, 50), at(x1, 0))).otherwise(upper)
    whole = F.array(at(x0, 0), at(x1, 0), at(x1, 50), at(x0, 50), at(x0, 0))
    parcel = F.when((site % 47 == 0) & (n == 1), F.array(F.array(whole), F.array(lower))).otherwise(F.array(F.array(lower), F.array(upper)))
    tip = x1 + F.col("l_linenumber") - 4.0
    spot, broken = g.point_wkb(x0, F.lit(1.0)), F.lit(b"\x01\x02\x00").cast("binary")
    river = (
        F.when(site % 23 == 0, spot).when((site % 31 == 0) & (n == 1), broken).when((site % 29 == 0) & (n == 2), spot)
        .otherwise(g.linestring_wkb(F.array(at(x0, 25), at(x0 + 50.0, 40), at(tip, 25))))
    )
    hedge = g.linestring_wkb(F.array(at(x0, 25), at(x0 + 10.0, 25), at(tip, 25)))

    def layer(name: str, shape: Column) -> Column:
        return F.struct(F.lit(name).alias("layer"), shape.alias("geometry"))

    drawn = rows.withColumn("l", F.explode(F.array(layer("Habitats", g.multipolygon_wkb(parcel)), layer("Rivers", river), layer("Hedgerows", hedge))))
    drawn = drawn.select("site_id", "l.layer", n.alias("feature_id"), F.col("parcel_ref").alias("feature_ref"), "l.geometry")
    w = F.col("w")
    bow = F.array(at(0, 0), at(w, 50), at(w, 0), at(0, 50), at(0, 0))
    line = F.when(site % 37 == 0, broken).otherwise(g.polygon_wkb(F.array(F.when(site % 43 == 0, bow).otherwise(roofed(w)))))
    hard = F.array(at(w - 5.0, 10), at(w + 5.0, 10), at(w + 5.0, 20), at(w, 20), at(w, 30), at(w - 5.0, 30), at(w - 5.0, 10))
    single = counts.withColumn(
        "l", F.explode(F.array(layer("Red Line Boundary", line), layer("iggis", g.polygon_wkb(F.array(hard)))))
    ).where("l.layer <> 'iggis' OR site_id % 5 = 0")
    single = single.select("site_id", "l.layer", F.lit(1).cast("long").alias("feature_id"), F.lit(None).cast("string").alias("feature_ref"), "l.geometry")
    features = drawn.unionByName(single).withColumns(
        {
            "stage": F.lit("baseline"), "habitat_kind": F.when(F.col("layer") == "Habitats", lk.AREA).otherwise("tree"),
            **{c: F.lit(None).cast("string") for c in ("base_name", "prop_name", "advance_raw", "delay_raw")},
        }
    )
    outline = F.array(at(-10, -10), at(450, -10), at(450, 500), at(450, 1000), at(-10, 1000), at(-10, -10))
    outlines = spark.range(1).select(F.lit("England").alias("outline"), g.polygon_wkb(F.array(outline)).alias("geometry"))
    head = F.concat(F.lit(gpkg.SQLITE_MAGIC), F.lit(bytes(52)), F.when(site % 61 == 0, F.lit(b"\x00\x00\x00\x00")).otherwise(F.lit(gpkg.GPKG_STAMP)))
    files = sites.withColumns(
        {
            "content": F.when(site % 53 == 0, F.lit(b"PK\x03\x04")).otherwise(head),
            "path": F.concat(F.lit("up/"), F.when(site % 59 == 0, F.repeat(F.lit("long"), 70)).otherwise(site.cast("string")), F.lit(".gpkg")),
            "length": F.lit(100).cast("long"),
        }
    )
    stamped = files.withColumn("code", gpkg.stamp_code(F.col("content"))).where("code IS NOT NULL").select("site_id", "stage", "code")
    named = lk.keyed_join(sites.withColumn("path", F.concat(F.lit("up/"), F.repeat(F.lit("long"), 70), F.lit(".gpkg"))).where(site % 59 == 0),
                          gpkg.metadata_faults(files, 1 << 30, 255).select("path", "code").distinct(), ["path"], "inner")
    plain = base.layers.where("table_name <> 'iggis'")
    return replace(
        base, features=features, layers=plain, outlines=outlines,
        file_faults=stamped.unionByName(named.select("site_id", "stage", "code")),
    )


EVERY_LAYER = f"""
WITH {q.PARCELS},
k AS (SELECT site_id, count(*) AS k, count(*) FILTER (n = 2) > 0 AS two FROM parcels GROUP BY 1),
ok AS (SELECT * FROM k WHERE site_id % 53 <> 0 AND site_id % 59 <> 0 AND site_id % 61 <> 0),
lined AS (SELECT * FROM ok WHERE site_id % 37 <> 0 AND site_id % 43 <> 0),
p AS (SELECT p.*, ok.k, l_quantity % 10 = 0 AS reaches, NOT (p.site_id % 47 = 0 AND n = 1) AS legal FROM parcels p JOIN ok ON ok.site_id = p.site_id),
beyond AS (SELECT p.*, n * 100.0 + l_linenumber - 4.0 AS tip, p.k * 100.0 AS w FROM p JOIN lined l ON l.site_id = p.site_id),
hedge AS (SELECT site_id, greatest(0.0, tip - w) AS m FROM beyond),
river AS (SELECT site_id, CASE WHEN tip > w THEN (tip - w) / (tip - (n - 1) * 100.0 - 50.0)
    * sqrt((tip - (n - 1) * 100.0 - 50.0) * (tip - (n - 1) * 100.0 - 50.0) + 225.0) ELSE 0.0 END AS m
  FROM beyond WHERE site_id % 23 <> 0 AND site_id % 31 <> 0 AND NOT (site_id % 29 = 0 AND n = 2)),
hits AS (
  SELECT site_id, 'GPKG_INVALID_FILE' AS code, 1 AS violations FROM k WHERE site_id % 53 = 0
  UNION ALL SELECT site_id, 'GPKG_NOT_A_GEOPACKAGE', 1 FROM k WHERE site_id % 61 = 0 AND site_id % 53 <> 0
  UNION ALL SELECT site_id, 'INVALID_FILE_METADATA', 1 FROM k WHERE site_id % 59 = 0
  UNION ALL SELECT site_id, 'DUPLICATE_HABITAT_REF', count(*) FROM
    (SELECT site_id, parcel_ref FROM p GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT site_id, 'GPKG_RLB_UNREADABLE_GEOMETRY', 1 FROM ok WHERE site_id % 37 = 0
  UNION ALL SELECT site_id, 'REDLINE_INVALID_GEOMETRY', 1 FROM ok WHERE site_id % 43 = 0 AND site_id % 37 <> 0
  UNION ALL SELECT site_id, 'AREA_PARCELS_INVALID_GEOMETRY', 1 FROM ok WHERE site_id % 47 = 0
  UNION ALL SELECT site_id, 'GPKG_RIVERS_NO_LINESTRING_GEOMETRY', 1 FROM ok WHERE site_id % 23 = 0
    OR (site_id % 29 = 0 AND k = 1 AND two)
  UNION ALL SELECT site_id, 'GPKG_RIVERS_UNREADABLE_GEOMETRY', 1 FROM ok WHERE site_id % 31 = 0 AND site_id % 23 <> 0
  UNION ALL SELECT site_id, 'GPKG_RIVERS_WRONG_GEOMETRY_TYPE', 1 FROM ok WHERE site_id % 29 = 0 AND two AND k > 1
    AND site_id % 23 <> 0 AND site_id % 31 <> 0
  UNION ALL SELECT a.site_id, 'PARCEL_OVERLAPS', count(*) FROM p a JOIN p b ON b.site_id = a.site_id AND b.n = a.n + 1
    WHERE a.reaches AND a.legal AND b.legal GROUP BY 1
  UNION ALL SELECT l.site_id, c.code, 1 FROM lined l JOIN p ON p.site_id = l.site_id AND p.n = l.k AND reaches AND legal
    CROSS JOIN (VALUES ('SLIVERS_OUTSIDE_REDLINE'), ('AREA_PARCELS_OUTSIDE_REDLINE')) c(code)
  UNION ALL SELECT site_id, 'HEDGEROWS_OUTSIDE_REDLINE', 1 FROM hedge GROUP BY site_id HAVING sum(m) > 0.1
  UNION ALL SELECT site_id, 'WATERCOURSES_OUTSIDE_REDLINE', 1 FROM river GROUP BY site_id HAVING sum(m) > 0.1
  UNION ALL SELECT site_id, 'IGGIS_OUTSIDE_REDLINE', 1 FROM lined WHERE site_id % 5 = 0
  UNION ALL SELECT l.site_id, 'AREA_SUM_MISMATCH', 1 FROM lined l WHERE EXISTS (SELECT 1 FROM p WHERE p.site_id = l.site_id AND legal)
  UNION ALL SELECT site_id, 'REDLINE_OUTSIDE_ENGLAND', 1 FROM lined WHERE k * 100.0 > 450.0)
SELECT site_id, code, CAST(violations AS BIGINT) AS violations FROM hits"""


@query("validate_every_layer", EVERY_LAYER)
def validate_every_layer(spark, folder):
    found = va.validate(every_layer(spark, folder))
    return found.groupBy("site_id", "code").agg(F.count(F.lit(1)).alias("violations"))


@query(
    "sql_geometry_functions",
    f"""{RECTANGLES} SELECT site_id, n, ((x1 - x0) * 50)::DOUBLE AS area_m2, ((x1 - x0) * 50)::DOUBLE AS shared_m2,
  (l_linenumber * 2.0)::DOUBLE AS outside_m, (l_linenumber * 1.0)::DOUBLE AS away_m, 'POLYGON' AS kind FROM box""",
)
def sql_geometry_functions(spark, folder):
    g.register(spark)
    beyond, mid = F.col("l_linenumber").cast("double"), F.lit(25.0)
    x0, x1 = (F.col("n") - 1) * 100.0, F.col("n") * 100.0 + F.when(F.col("l_quantity") % 10 == 0, 1.0).otherwise(0.0)
    boxes(spark, folder).withColumns(
        {"line": g.line_wkb(x0 - beyond, mid, x1 + beyond, mid), "point": g.point_wkb(x1 + beyond, mid)}
    ).repartition(spark.sparkContext.defaultParallelism).createOrReplaceTempView("parcel_boxes")  # dear functions
    return spark.sql(
        """SELECT site_id, n, habitat_area(geometry) AS area_m2, habitat_overlap_area(geometry, geometry) AS shared_m2,
  round(habitat_length_outside(line, geometry), 6) AS outside_m, round(habitat_distance_outside(point, geometry), 6) AS away_m,
  habitat_geometry_facts(geometry).kind AS kind FROM parcel_boxes"""
    )

