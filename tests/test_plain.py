"""Plain cases are settled without joins: sound catalogues, legal shapes, shapes inside their boundary."""

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from hedgewise.functions import geometry as g
from hedgewise.functions.plain_fit import whole_groups
from hedgewise.operators import generate as gen
from hedgewise.operators import shape_rules as sr
from hedgewise.operators import spatial as sp
from hedgewise.operators import structure_rules as st
from hedgewise.plans import literal_table, written
from tests.test_geometry import BOW, HOLE, SQUARE, multi, polygon, shift


def rows_of(spark, rows):
    return sr.with_facts(spark.createDataFrame(rows, "site_id long, stage string, layer string, feature_id long, feature_ref string, geometry binary"))


def test_only_shapes_that_may_break_a_rule_are_joined(spark):
    """shapes plainly inside their boundary and beside each other reach no join; sites are compared within a batch."""
    square = lambda x, y, s=10.0: bytearray(polygon([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]))
    point = lambda x, y: bytearray(struct.pack("<BIdd", 1, 1, x, y))
    roofed = bytearray(polygon([(0, 0), (100, 0), (100, 50), (50, 60), (0, 50), (0, 0)]))
    lines = {1: [square(0, 0, 100.0)], 2: [roofed], 3: [square(0, 0, 100.0)] * 2, 4: []}
    rows = []
    for site, redline in lines.items():
        rows += [(site, "baseline", "Red Line Boundary", i, None, r) for i, r in enumerate(redline)]
        parcels = [square(0, 0), square(10, 0), square(9, 9), square(95, 20), square(60, 40)]
        rows += [(site, "baseline", "Habitats", i, str(i), p) for i, p in enumerate(parcels)]
        trees = [point(50, 20), point(100, 20), point(101, 20)]
        rows += [(site, "baseline", "Urban Trees", i, str(i), p) for i, p in enumerate(trees)]
    found = sp.to_look_at(rows_of(spark, rows).repartition(3)).collect()
    near = {(r.site_id, r.layer[0], r.feature_id) for r in found if r.near}
    # a place on a side is plainly inside a box, but left to the rules where the boundary is none
    whole = {(3, "H", i) for i in range(5)} | {(3, "U", i) for i in range(3)}
    assert near == {(1, "H", 3), (1, "U", 2), (2, "H", 3), (2, "U", 1), (2, "U", 2)} | whole
    assert {(r.site_id, r.feature_id) for r in found if r.meets} == {(s, i) for s in lines for i in (0, 1, 2)}
    assert {r.site_id for r in found if r.layer == "Red Line Boundary"} == {1, 2, 3}
    # sites that are too large for a batch are left to the joins whole
    crowded = sp.to_look_at(rows_of(spark, rows), most=8).collect()
    assert {(r.site_id, r.near) for r in crowded if r.layer == "Habitats" and r.feature_id == 4} == {(1, True), (2, True), (3, True)}


def test_groups_of_a_batch_stay_whole():
    rows = pa.RecordBatch.from_pydict({"a": [1, 1, 1, 2, 2, 3, 3, 3, 3, 4], "b": ["x", "x", "y", "x", "x", "x", "x", "x", "x", "x"]})
    for size in (1, 2, 3, 10):
        got = [(b.to_pydict(), g.tolist()) for b, g in whole_groups((rows.slice(i, size) for i in range(0, 10, size)), 2)]
        keys = [{(a, b) for a, b in zip(d["a"], d["b"], strict=True)} for d, _ in got]
        assert sum(len(d["a"]) for d, _ in got) == 10 and sum(map(len, keys)) == 5
        assert all(max(g) + 1 == len(k) for (_, g), k in zip(got, keys, strict=True))


def test_only_shapes_that_may_be_illegal_become_edges(spark, monkeypatch):
    """rings and edges are made of shapes that are not plainly legal."""
    tile = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]
    shapes = {
        "plain": polygon([(0, 0), (10, 0), (10, 10), (5, 12), (0, 0)]), "parts": multi(polygon(tile), polygon(shift(tile, 9))),
        "bow": polygon(BOW), "hole": polygon(SQUARE, HOLE), "open": polygon([(0, 0), (9, 0), (9, 9)]),
        "again": polygon([(0, 0), (5, 0), (5, 0), (5, 5), (0, 0)]), "flat": polygon([(0, 0), (5, 0), (9, 0), (0, 0)]),
        "back": polygon([(0, 0), (10, 0), (10, 10), (10, 5), (10, 12), (0, 12), (0, 0)]), "over": multi(polygon(tile), polygon(shift(tile, 5))),
    }
    told = dict(zip(shapes, g.plainly_legal.func(pa.array(shapes.values(), pa.binary())).to_pylist(), strict=True))
    assert [name for name, legal in told.items() if legal] == ["plain", "parts"]
    kept = []
    monkeypatch.setattr(sr, "written", lambda df, label: kept.append((label, written(df, label))) or kept[-1][1])
    rows = [(1, "baseline", "Habitats", i, n, bytearray(s)) for i, (n, s) in enumerate(shapes.items())]
    assert {r.feature_ref for r in sr.with_faults(rows_of(spark, rows)).where("fault IS NULL").collect()} == {"plain", "parts", "hole", "again"}
    assert dict(kept)["doubtful-shapes"].count() == 7


def test_only_doubtful_sites_are_looked_at_closely(spark, monkeypatch):
    """a site whose catalogues say what the template says is not described."""
    sites = spark.range(40).select(F.col("id").alias("site_id"), F.lit("baseline").alias("stage"))
    at = F.col("site_id")
    tables = sites.withColumn("table_name", F.explode(F.array(*map(F.lit, st.SYSTEM_TABLES)))).where("NOT (site_id = 1 AND table_name = 'gpkg_contents')")
    names = literal_table(spark, "table_name string, kind string", [("Red Line Boundary", "POLYGON"), ("Habitats", "MULTIPOLYGON")])
    listed = sites.crossJoin(names)
    layers = listed.where("NOT (site_id = 2 AND table_name = 'Habitats')").select(
        "site_id", "stage", "table_name", F.when((at == 3), "tiles").otherwise("features").alias("data_type"),
        F.when(at == 4, 4326).otherwise(27700).alias("contents_srs_id"),
    )
    extra = sites.where("site_id = 5").selectExpr("*", "'more' AS table_name", "'features' AS data_type", "27700 AS contents_srs_id")
    geometry = listed.where("site_id <> 6").select(
        "site_id", "stage", "table_name", F.when(at == 7, "geo m").otherwise("geom").alias("column_name"),
        F.when(at == 8, "POINT").otherwise(F.col("kind")).alias("geometry_type"), F.when(at == 9, 4326).otherwise(27700).alias("srs_id"),
    )
    wanted = [(t, f"c{i}", "INTEGER", i == 0, i == 0) for t in ("Red Line Boundary", "Habitats") for i in range(70)]
    wanted = literal_table(spark, "table_name string, column_name string, sqlite_type string, not_null boolean, is_pk boolean", wanted)
    columns = sites.crossJoin(wanted).where("NOT (site_id = 10 AND table_name = 'Habitats' AND column_name = 'c69')").withColumns(
        {
            "sqlite_type": F.when((at == 11) & (F.col("column_name") == "c5"), "TEXT").otherwise(F.col("sqlite_type")),
            "not_null": F.when(at == 12, F.lit(True)).otherwise(F.col("not_null")), "is_pk": F.when(at == 13, F.lit(True)).otherwise(F.col("is_pk")),
        }
    )
    double = [geometry.where("site_id = 14"), columns.where("site_id = 15 AND column_name = 'c1'").withColumn("sqlite_type", F.lit("POLYGON"))]
    given = (sites, tables, layers.unionByName(extra), geometry.unionByName(double[0]), columns.unionByName(double[1]), names.withColumnRenamed("kind", "geometry_type"), wanted)
    assert {r.site_id for r in st.doubtful_sites(*given).collect()} == set(range(1, 16))
    closely = {(r.site_id, r.code) for r in st.structure_rules(*given).collect()}
    described, seen = st.described, []
    monkeypatch.setattr(st, "described", lambda *rows: seen.append(described(*rows)) or seen[-1])
    st.structure_rules(*given)
    assert {r.site_id for r in seen[0].select("site_id").distinct().collect()} == set(range(1, 16))
    monkeypatch.setattr(st, "doubtful_sites", lambda sites, *_: sites.select("site_id", "stage").distinct())
    assert {(r.site_id, r.code) for r in st.structure_rules(*given).collect()} == closely


def test_flaws_ride_along_with_sites(spark):
    """features that carry their site's flaw are the same as those joined with it, also where sites and flaws repeat, and
    are not shuffled."""
    sites = spark.range(1, 60, 1, 2).select(
        F.col("id").alias("site_id"), F.when(F.col("id") == 7, 5000).otherwise(F.col("id") % 6 + 3).cast("long").alias("parcels"),
        F.lit(7).cast("long").alias("seed"), (F.col("id") * 10.0).alias("x"), F.lit(5.0).alias("y"),
    )
    sites = sites.unionByName(sites.where("site_id = 9"))
    names = F.array(*map(F.lit, (*gen.FLAWS, "none")))
    flaws = sites.select("site_id", F.get(names, (F.col("site_id") % (len(gen.FLAWS) + 1)).cast("int")).alias("flaw")).where("flaw <> 'none'")
    of = [["Broad 0 - Type 0"], ["Good", "Poor"], ["Hedge 0"], ["Water 0"]]
    carried = gen.generate(gen.planned_sites(sites, flaws), *of, carried=gen.PLAN.values())
    ridden = gen.inject_flaws(carried, flaws, sites, "Broad 1 - Type 1")
    joined = gen.inject_flaws(gen.generate(sites, *of), flaws, sites, "Broad 1 - Type 1")
    assert ridden.columns == joined.columns and ridden.count() == joined.count()
    assert ridden.exceptAll(joined).isEmpty() and joined.exceptAll(ridden).isEmpty()
    plan = gen.inject_flaws(carried, flaws, sites, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Repartition")[0]
