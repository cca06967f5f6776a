"""What keeps the queries linear: joins that do not trust shrunk estimates, batches decoded as a whole, bounded batches."""

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hedgewise.functions import geometry as g
from hedgewise.functions.scalars import layer_ref, trimmed
from hedgewise.operators import edges as ed
from hedgewise.operators import generate as gen
from hedgewise.operators import shape_rules as sr
from hedgewise.operators import spatial as sp
from hedgewise.plans import fits_in_broadcast, keyed_join, numbered, written
from hedgewise.sources import gpkg
from workload import storage


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def boxes(spark, rows=4_000_000):
    site = F.col("id")
    return sr.with_facts(
        spark.range(rows).select(
            (site / 4).cast("long").alias("site_id"), F.lit("baseline").alias("stage"), F.lit("Habitats").alias("layer"),
            site.alias("feature_id"), F.lit("a").alias("feature_ref"),
            g.box_wkb(site * 1.0, F.lit(0.0), site + 1.0, F.lit(1.0)).alias("geometry"),
        )
    )


def test_rows_behind_dropped_wide_columns_are_not_small(spark):
    """four million rows, of which the optimizer expects less than 8 MB once geometry and facts are dropped."""
    rows = boxes(spark).where("status = 'ok'").select("site_id")
    assert 4 * int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 32 << 20
    assert not fits_in_broadcast(rows)


def test_sums_and_numbers_of_many_sites_are_not_broadcast(spark):
    """both sides have a row per site."""
    rows = boxes(spark)
    assert "BroadcastHashJoin" not in plan_of(sp.area_sum_rule(rows, rows))
    placed = numbered(rows.select("site_id", "feature_id"), ["site_id"], ["feature_id"], "n", {"s": F.floor("feature_id")})
    assert "BroadcastHashJoin" not in plan_of(placed)


def test_a_join_without_skew_is_a_plain_one(spark):
    """no keys are counted again and no rows dealt where no key is hot."""
    even = spark.range(50_000).select((F.col("id") % 5000).alias("k"), "id")
    hot = spark.range(50_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(5000).select(F.col("id").alias("k"), (-F.col("id")).alias("v"))
    for many, dealt in ((even, False), (hot, True)):
        joined = keyed_join(many, one, ["k"], "inner", max_bytes=-1)
        assert ("dealt to part" in plan_of(joined)) == dealt
        assert joined.count() == many.join(one, "k").count()


def line(*points):
    return struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<2d", *p) for p in points)


def polygon(*rings):
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(
        struct.pack("<I", len(r) + 1) + b"".join(struct.pack("<2d", *p) for p in [*r, r[0]]) for r in rings
    )


def drawn(random, corners):
    return polygon(random.uniform(-9, 9, (corners, 2)))


def test_shapes_of_a_batch_are_decoded_by_layout(monkeypatch):
    """One decoding per layout, and the same facts and rings as shape by shape."""
    random = np.random.default_rng(1)
    shapes = [drawn(random, 3 + i % 3) for i in range(300)] + [line((0, 0), (3, 4)), b"", None, b"\x01\x03", line((0, np.nan), (1, 1))]
    shapes.append(polygon([(0, 0), (9, 0), (9, 9), (0, 9)], [(1, 1), (2, 1), (2, 2)]))
    calls, decode = [], g._decode

    def counted(*args):
        calls.append(1)
        return decode(*args)

    monkeypatch.setattr(g, "_decode", counted)
    facts = g.geometry_facts.func(pa.array(shapes, pa.binary())).to_pylist()
    assert len(calls) < 10
    for shape, found in zip(shapes, facts):
        for want, got in zip(g._facts(shape), found.values()):
            assert got == (pytest.approx(want) if isinstance(want, float) else want)
    rings = g.rings.func(pa.array(shapes, pa.binary())).to_pylist()
    assert [r["ring"] for r in rings[-1]] == [0, 1] and rings[-1][1]["points"][1] == {"x": 2.0, "y": 1.0}
    assert rings[0][0]["points"][0]["x"] == g._parts(shapes[0])[1][0][0][0, 0]


def test_sql_measures_of_a_batch_agree_with_those_of_each_pair():
    """shapes of several layouts, with touching and coinciding edges."""
    random = np.random.default_rng(2)
    whole = [polygon(random.integers(0, 6, (4, 2)).astype(float)) for _ in range(100)]
    areal = [drawn(random, 3 + i % 3) for i in range(100)] + whole
    lines = [line(*random.integers(0, 6, (2 + i % 2, 2)).astype(float)) for i in range(200)]
    edges = [g._edges(g._parts(s)[1]) for s in areal]
    paths = [g._edges(g._parts(s)[1]) for s in lines]

    def batch(function, a, b):
        return function.func(pa.array([*a, None], pa.binary()), pa.array([*b, b[0]], pa.binary())).to_pylist()

    other = edges[::-1]
    assert batch(g.overlap_area, areal, areal[::-1]) == [*[pytest.approx(g._overlap(*p), abs=1e-6) for p in zip(edges, other)], None]
    assert batch(g.length_outside, lines, areal) == [
        *[pytest.approx(g._length_outside(*p), abs=1e-6) for p in zip(paths, edges)], None
    ]
    away = [np.where(g._inside(e, p[:, :2]), 0.0, g._distances(e, p[:, :2])) for p, e in zip([np.vstack([p, p[-1, [2, 3, 0, 1]]]) for p in paths], edges)]
    assert batch(g.distance_outside, lines, areal) == [*[pytest.approx(a.max(), abs=1e-6) for a in away], None]


def test_files_are_made_and_read_in_small_batches(spark, tmp_path):
    """A few bytes of a part make a file of many, so tasks and batches follow the files."""
    rows = pd.DataFrame({"p_partkey": range(300), "p_name": "x", "p_size": 3})
    assert max(len(b) for b in storage._site_files(iter([rows]))) <= 64
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    files = storage.site_files(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = gpkg.scan(files)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) <= gpkg.BATCH_BYTES
    assert found.where("record = 'status'").count() == 300


def test_trimming_looks_at_the_ends_only(spark):
    """a run of blanks within a line is not tried from each of its places."""
    blanks = "\t \u00a0\u2003\ufeff\u000b"
    texts = [(f"{blanks}a{blanks}b{blanks}",), ("a" + " " * 200_000 + "b ",), (blanks,), ("",), (None,)]
    found = spark.createDataFrame(texts, "t string").select(trimmed(F.col("t")).alias("t"))
    assert "regexp" not in plan_of(found)
    assert [r.t for r in found.collect()] == [f"a{blanks}b", "a" + " " * 200_000 + "b", "", "", None]


def multipolygon(*parts):
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(parts)


def shapes_of(spark, random, count=60):
    """Shapes of one or two parts, some with a hole, on whole and on other coordinates."""
    rows = []
    for key in range(count):
        corners = [random.integers(0, 8, (4, 2)) if key % 2 else random.uniform(-9, 9, (4 + key % 9, 2)) for _ in range(4)]
        parts = [polygon(corners[0], corners[1]), polygon(corners[2])][: 1 + key % 2]
        rows.append((key, multipolygon(*parts)))
    return spark.createDataFrame(rows, "shape_key long, geometry binary")


def test_shapes_of_few_edges_are_looked_over_within_their_rows(spark):
    """the same crossings as by joins of edges, without one."""
    shapes = shapes_of(spark, np.random.default_rng(3))
    looks = shapes.select("shape_key", g.few_edges_look("geometry").alias("look"))
    looked = [r.shape_key for r in looks.where("look.crossings IS NOT NULL").collect()]
    assert len(looked) > 40
    found = sr._looked_faults(looks)
    assert "Join" not in plan_of(found)
    by_edges = sr._crossing_faults(ed.edge_rows(shapes.where(F.col("shape_key").isin(looked)), ["shape_key"]))
    assert {*found.collect()} == {*by_edges.collect()} and not found.isEmpty()


def test_groups_of_few_edges_are_swept_within_a_row(spark):
    """the same areas as by bands; larger groups, and those beside them, as before."""
    shapes = shapes_of(spark, np.random.default_rng(4))
    wheel = [(9 * np.cos(a), 9 * np.sin(a)) for a in np.linspace(0, 6.2, g.ROW_EDGES + 9)]
    shapes = shapes.unionByName(spark.createDataFrame([(-1, multipolygon(polygon(wheel)))], shapes.schema))
    edges = ed.edge_rows(shapes, ["shape_key"]).select("shape_key", F.col("part").cast("long").alias("owner"), (F.col("ring") > 0).alias("of_b"), *ed.XY)
    rising = edges.where("y1 < y2").unionByName(
        edges.where("y1 > y2").select("shape_key", "owner", "of_b", *[F.col(a).alias(b) for a, b in zip(["x2", "y2", "x1", "y1"], ed.XY)])
    )
    few = ed._swept_in_rows(rising.where("shape_key >= 0"), ["shape_key"])
    assert "Join" not in plan_of(few)
    found = {r.shape_key: r for r in ed.swept(edges, ["shape_key"]).collect()}
    by_bands = {r.shape_key: r for r in ed._swept_by_bands(edges, rising, ["shape_key"]).collect()}
    assert found.keys() == by_bands.keys() and -1 in found
    for key, want in by_bands.items():
        assert [found[key][c] for c in ("only_a", "both", "twice")] == pytest.approx([want[c] for c in ("only_a", "both", "twice")])


def test_only_numbers_that_overrides_have_are_shuffled(spark):
    """rows of other layers and numbers pass by the join; what is pinned is pinned as before."""
    sites = spark.range(3).select(
        F.col("id").alias("site_id"), F.lit(6).cast("long").alias("parcels"), F.lit(7).cast("long").alias("seed"),
        F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
    )
    made = gen.generate(sites, ["A", "B"], ["Good", "Poor"], ["H"], ["R"])
    pins = spark.createDataFrame([(0, 1, "Pin"), (1, 2, "Other"), (9, 2, "No site"), (None, None, "Nowhere")], "site_id long, pin_no int, full_name string")
    pinned = gen.pin_habitats(made, pins)
    joined = written(made.where(gen._numbers_within(pins.select("site_id", F.lit("Habitats").alias("layer"), F.col("pin_no").alias("feature_id")))), "within")
    assert joined.groupBy("layer").agg(F.max("feature_id").alias("n")).collect() == [("Habitats", 2)]
    assert pinned.count() == made.count()
    changed = {(r.site_id, r.feature_id, r.base_name, r.prop_name, r.retention) for r in pinned.exceptAll(made).collect()}
    assert changed == {(0, 1, "Pin", "Pin", "Retained"), (1, 2, "Other", "Other", "Retained")}


def test_refs_are_padded_without_formatting(spark):
    """the same text as %03d."""
    numbers = [0, 7, 10, 99, 100, 999, 1000, 123456789, -1, -9, -10, -99, -100, -(2**63), 2**63 - 1, None]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    found = rows.select(layer_ref("habitats", F.col("n")).alias("ref"), F.format_string("H%03d", "n").alias("said"))
    assert "format_string" not in plan_of(found.select("ref"))
    assert [r.ref for r in found.collect()] == [r.said for r in found.collect()]


def test_box_outlines_are_settled_by_extents(spark, monkeypatch):
    """no boundary that is a box is gathered, decoded or swept for an outline that is one."""
    lines = sr.with_facts(
        spark.range(4).select(
            F.col("id").alias("site_id"), F.lit("baseline").alias("stage"), F.lit("Red Line Boundary").alias("layer"),
            F.lit(1).alias("feature_id"), F.lit(None).cast("string").alias("feature_ref"),
            g.box_wkb(F.lit(0.0), F.lit(0.0), (F.col("id") + 1) * 100.0, F.lit(50.0)).alias("geometry"),
        )
    )
    outline = spark.range(1).select(F.lit("England").alias("outline"), g.box_wkb(*map(F.lit, (-10.0, -10.0, 250.0, 1000.0))).alias("geometry"))
    asked = []
    measure = sp.outside_areas
    monkeypatch.setattr(sp, "outside_areas", lambda near, line: asked.append(near.count()) or measure(near, line))
    found = sp.outline_rule(lines, outline)
    assert {(r.site_id, r.detail) for r in found.collect()} == {(2, "2500.00 m2"), (3, "7500.00 m2")}
    assert asked == [0]


def test_extents_of_a_batch_are_taken_point_by_point():
    """and a shape with a point that is not finite is still unreadable."""
    random = np.random.default_rng(5)
    points = random.uniform(-9, 9, (50, 5, 2))
    low, high = g._extents(points)
    assert (low == points.min(1)).all() and (high == points.max(1)).all()
    odd = [line((0, 0), (np.inf, 1)), line((0, 0), (1, -np.inf)), line((np.nan, 0), (1, 1)), line((0, 0), (3, 4))]
    assert g.geometry_facts.func(pa.array(odd, pa.binary())).field("status").to_pylist() == ["unreadable"] * 3 + ["ok"]
