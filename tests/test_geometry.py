"""Geometry functions against shapes whose measures are known, and flaws against rules."""

import struct

import pytest
from pyspark.sql import functions as F

from hedgewise.functions import geometry as g
from hedgewise.operators import generate as gen
from hedgewise.operators import shape_rules as sr
from hedgewise.operators import spatial as sp
from hedgewise.operators import validate as va
from hedgewise.plans import literal_table, written

CONDITIONS = ["Good", "Moderate", "Poor"]


def polygon(*rings):
    data = struct.pack("<BII", 1, 3, len(rings))
    for ring in rings:
        data += struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    return data


def multi(*polygons):
    return struct.pack("<BII", 1, 6, len(polygons)) + b"".join(polygons)


def line(*points):
    return struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<2d", *p) for p in points)


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
LSHAPE = [(0, 0), (10, 0), (10, 5), (5, 5), (5, 10), (0, 10), (0, 0)]
BOW = [(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]


def shift(ring, dx, dy=0.0):
    return [(x + dx, y + dy) for x, y in ring]


def test_facts():
    assert g._facts(polygon(SQUARE, HOLE))[2] == 96.0
    assert g._facts(polygon(SQUARE))[8] is True and g._facts(polygon(LSHAPE))[8] is False
    assert g._facts(multi(polygon(SQUARE), polygon(shift(SQUARE, 20))))[2] == 200.0
    assert g._facts(b"\x01\x03\x00")[0] == "unreadable" and g._facts(None)[0] == "missing"


def test_overlap():
    def shared(a, b):
        return g._overlap(g._edges(g._parts(a)[1]), g._edges(g._parts(b)[1]))

    assert shared(polygon(SQUARE), polygon(shift(SQUARE, 5))) == pytest.approx(50)
    assert shared(polygon(SQUARE), polygon(shift(SQUARE, 10))) == pytest.approx(0)
    assert shared(polygon(LSHAPE), polygon(shift(SQUARE, 5, 5))) == pytest.approx(0)
    assert shared(polygon(LSHAPE), polygon(shift(SQUARE, 4, 4))) == pytest.approx(11)
    assert shared(polygon(SQUARE, HOLE), polygon(HOLE)) == pytest.approx(0)
    diamond = [(5, -5), (15, 5), (5, 15), (-5, 5), (5, -5)]
    assert shared(polygon(SQUARE), polygon(diamond)) == pytest.approx(100)


def test_lines_and_points():
    region = g._edges(g._parts(polygon(LSHAPE))[1])

    def outside(*points):
        return g._length_outside(g._edges(g._parts(line(*points))[1]), region)

    assert outside((0, 0), (10, 0)) == pytest.approx(0)
    assert outside((2, 7), (12, 7)) == pytest.approx(7)
    assert outside((-3, 2), (12, 2)) == pytest.approx(5)


def test_overlaps_of_mixed_sizes(spark):
    shapes = [
        (1, polygon(SQUARE)), (2, polygon(shift(SQUARE, 9.0))), (3, polygon([(0, 0), (3000, 0), (3000, 4), (0, 4), (0, 0)])),
        (4, polygon(shift(LSHAPE, 100.0, 2.0))), (5, polygon(shift(SQUARE, 500.0, 500.0))), (6, polygon([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])),
    ]
    rows = [("X'" + s.hex() + "'", i) for i, s in shapes]
    features = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({h}, {i})" for h, i in rows) + " AS t(geometry, feature_id)")
    features = features.withColumns({"site_id": F.lit(1), "stage": F.lit("baseline"), "feature_ref": F.col("feature_id").cast("string")})
    pairs = sp.overlapping_pairs(sr.with_facts(features)).collect()
    found = {(p.id_a, p.id_b): round(p.overlap_m2, 6) for p in pairs}
    assert found == {(1, 2): 10.0, (1, 3): 40.0, (2, 3): 40.0, (3, 4): 20.0, (1, 6): 1.0, (3, 6): 1.0}


@pytest.fixture(scope="module")
def flaw_codes(spark):
    flaws = literal_table(spark, "site_id long, flaw string", list(enumerate(gen.FLAWS, 1)))
    sites = spark.range(0, len(gen.FLAWS) + 1, 1, 2).select(
        F.col("id").alias("site_id"), F.lit(8).cast("long").alias("parcels"), F.lit(7).cast("long").alias("seed"),
        F.lit(530000.0).alias("x"), F.lit(180000.0).alias("y"),
    )
    base = gen.flawed_sites(sites, flaws)
    names = ["Broad 0 - Type 0"]
    made = gen.generate(base, names, CONDITIONS, ["Hedge 0"], ["Water 0"])
    flawed = gen.inject_flaws(made, flaws, base, "Broad 1 - Type 1").withColumn("stage", F.lit("baseline"))
    features = written(sr.with_facts(flawed), "flaw-test")
    shapes = sr.shape_rules(base.withColumn("stage", F.lit("baseline")), features).unionByName(sr.legal_shape_rules(features))
    outline = spark.range(1).select(
        F.lit("England").alias("outline"), g.box_wkb(F.lit(0.0), F.lit(0.0), F.lit(7e5), F.lit(1.3e6)).alias("geometry")
    )
    from hedgewise.operators import attribute_rules as ar

    habitat = literal_table(spark, "kind string, name string, band string", [("area", "Broad 1 - Type 1", "High")])
    found = va.union(
        [
            shapes, sp.fit_rules(va.without(features, shapes), outline),
            ar.attribute_rules(features.where("layer = 'Habitats'").withColumn("kind", F.lit("area")), habitat),
        ]
    ).collect()
    names = {0: "none", **dict(enumerate(gen.FLAWS, 1))}
    codes = {name: set() for name in names.values()}
    for row in found:
        codes[names[row.site_id]].add(row.code)
    return codes


@pytest.mark.parametrize(
    "flaw,code",
    [
        ("self-intersecting-redline", "REDLINE_INVALID_GEOMETRY"), ("bowtie-parcel", "AREA_PARCELS_INVALID_GEOMETRY"),
        ("overlapping-parcels", "PARCEL_OVERLAPS"), ("parcel-outside-redline", "AREA_PARCELS_OUTSIDE_REDLINE"),
        ("parcel-too-small", "AREA_PARCELS_TOO_SMALL"), ("area-sum-mismatch", "AREA_SUM_MISMATCH"),
        ("hedgerow-outside", "HEDGEROWS_OUTSIDE_REDLINE"), ("watercourse-outside", "WATERCOURSES_OUTSIDE_REDLINE"),
        ("tree-outside", "TREES_OUTSIDE_REDLINE"), ("iggi-outside", "IGGIS_OUTSIDE_REDLINE"),
        ("redline-not-in-england", "REDLINE_OUTSIDE_ENGLAND"), ("redline-too-large", "REDLINE_AREA_TOO_LARGE"),
        ("no-habitats", "NO_HABITAT_AREAS"), ("distinctiveness-out-of-scope", "HABITAT_DISTINCTIVENESS_NOT_IN_SCOPE"),
        ("duplicate-habitat-ref", "DUPLICATE_HABITAT_REF"), ("advance-delay-both-set", "ADVANCE_AND_DELAY_BOTH_SET"),
    ],
)
def test_flaw_trips_its_rule(flaw_codes, flaw, code):
    assert code in flaw_codes[flaw]


def test_clean_sites_pass(flaw_codes):
    for name in ("none", "tiny-gap", "no-hedgerows", "no-rivers", "no-trees"):
        assert flaw_codes[name] == set(), name


def test_generation_is_partition_independent(spark):
    def run(parts, seed):
        sites = spark.range(0, 40, 1, parts).select(
            F.col("id").alias("site_id"), (F.col("id") % 9 + 3).alias("parcels"), F.lit(seed).cast("long").alias("seed"),
            F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
        )
        return sorted(map(str, gen.generate(sites, ["A - B", "C - D"], CONDITIONS, ["H"], ["R"]).collect()))

    assert run(1, 7) == run(5, 7)
    assert run(1, 7) != run(1, 8)
