"""Rules on the shapes of one layer at a time: present, readable, of the right kind, legal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgewise.functions.geometry import few_edges_look, geometry_facts, plainly_legal
from hedgewise.operators import edges as ed
from hedgewise.operators.violations import SITE, union, violation
from hedgewise.plans import keyed_join, sized_join, written
from hedgewise.schema import LAYER_TABLES

SHAPES, READABLE, LEGAL = "shapes", "readable", "legal_shapes"

AREAL = ("POLYGON", "MULTIPOLYGON")
LINEAR = ("LINESTRING", "MULTILINESTRING")
REDLINE, HABITATS = LAYER_TABLES["redline"], LAYER_TABLES["habitats"]
HEDGEROWS, RIVERS = LAYER_TABLES["hedgerows"], LAYER_TABLES["rivers"]

# Code name part per layer.
LAYER_CODES = {REDLINE: "RLB", HABITATS: "HABITATS", HEDGEROWS: "HEDGEROWS", RIVERS: "RIVERS"}


def with_facts(features: DataFrame, column: str = "geometry") -> DataFrame:
    """Decode each geometry once; everything after reads plain columns. ``shape_key`` names a shape: equal rows share it."""
    named = [c for c in (*SITE, "layer", "feature_id", "feature_ref", column) if c in features.columns]
    keyed = features.withColumn("shape_key", F.xxhash64(*named))
    return keyed.withColumn("facts", geometry_facts(F.col(column))).select("*", "facts.*").drop("facts")


def layer_counts(features: DataFrame) -> DataFrame:
    """Per site and layer: rows, area shapes, lines, other readable shapes, unreadable rows. Rows with ``status`` 'none' stand for
    a layer alone."""
    drawn = F.col("status") == "ok"
    areal, linear = F.col("kind").isin(*AREAL), F.col("kind").isin(*LINEAR)
    return features.groupBy(*SITE, "layer").agg(
        F.count_if(F.coalesce(F.col("status") != "none", F.lit(True))).alias("rows"),
        F.count_if(drawn & areal).alias("areas"),
        F.count_if(drawn & linear).alias("lines"),
        F.count_if(drawn & ~areal).alias("not_areas"),
        F.count_if(drawn & ~linear).alias("not_lines"),
        F.count_if(F.col("status") == "unreadable").alias("unreadable"),
    )


def shape_rules(sites: DataFrame, features: DataFrame) -> DataFrame:
    """Presence, kind and readability of shapes from one count per site and layer.

    ``features`` has ``layer``, ``status`` and ``kind``. An unreadable row stops the
    layer's other checks; an optional layer without rows passes.
    """
    # A layer without any row has no count of its own, so both required layers are added.
    required = sites.select(*SITE).distinct().withColumn(
        "layer", F.explode(F.array(F.lit(REDLINE), F.lit(HABITATS)))
    )
    required = required.withColumns({"status": F.lit("none"), "kind": F.lit(None).cast("string")})
    full = layer_counts(features.select(*SITE, "layer", "status", "kind").unionByName(required))
    readable = F.col("unreadable") == 0

    def on(layer: str, condition: Column, code: str) -> Column:
        return F.when((F.col("layer") == layer) & readable & condition, F.lit(code))

    checks = [
        on(REDLINE, F.col("rows") == 0, "NO_REDLINE"),
        on(REDLINE, F.col("areas") == 0, "GPKG_RLB_NO_POLYGON"),
        on(REDLINE, F.col("rows") > 1, "GPKG_RLB_TOO_MANY_POLYGONS"),
        on(HABITATS, F.col("areas") == 0, "NO_HABITAT_AREAS"),
        on(HABITATS, (F.col("areas") > 0) & (F.col("not_areas") > 0), "GPKG_HABITATS_WRONG_GEOMETRY_TYPE"),
    ]
    for layer in (HEDGEROWS, RIVERS):
        name = LAYER_CODES[layer]
        checks.append(
            on(layer, (F.col("rows") > 0) & (F.col("lines") == 0), f"GPKG_{name}_NO_LINESTRING_GEOMETRY")
        )
        checks.append(
            on(layer, (F.col("lines") > 0) & (F.col("not_lines") > 0), f"GPKG_{name}_WRONG_GEOMETRY_TYPE")
        )
    shapes = full.withColumn("code", F.explode(F.array_compact(F.array(*checks))))
    unreadable = full.where(F.col("layer").isin(*LAYER_CODES) & ~readable)
    code = F.lit(None).cast("string")
    for layer, name in LAYER_CODES.items():
        code = F.when(F.col("layer") == layer, F.lit(f"GPKG_{name}_UNREADABLE_GEOMETRY")).otherwise(code)
    return union(
        [
            violation(shapes, SHAPES, F.col("code"), F.col("layer")),
            violation(unreadable, READABLE, code, F.col("layer"), detail=F.col("unreadable")),
        ]
    )


PLACED = "format_string('%s at %.2f %.2f', {0}, {1}, {2})"


def _ring_faults(ring: DataFrame) -> DataFrame:
    """Faults that a ring shows by itself. ``p`` are its points without immediate repeats."""
    step = "struct(b.x - a.x AS dx, b.y - a.y AS dy)"
    ring = ring.withColumns(
        {
            "p": F.expr("filter(points, (p, k) -> k = 0 OR p.x <> points[k - 1].x OR p.y <> points[k - 1].y)"),
            "size": F.size("points"),
        }
    )
    ring = ring.withColumn("n", F.size("p") - 1).withColumn(
        "d", F.expr(f"zip_with(slice(p, 1, greatest(n, 0)), slice(p, 2, greatest(n, 0)), (a, b) -> {step})")
    )
    turned = """get(filter(sequence(0, n - 1), k -> d[k].dx * d[(k + 1) % n].dy = d[k].dy * d[(k + 1) % n].dx
        AND d[k].dx * d[(k + 1) % n].dx + d[k].dy * d[(k + 1) % n].dy < 0), 0)"""
    first = "coalesce(get(points, 0).x, 0D)", "coalesce(get(points, 0).y, 0D)"
    closed = "size >= 4 AND get(points, 0) = get(points, size - 1)"
    ring = ring.withColumn("back", F.expr(f"CASE WHEN {closed} AND n >= 3 THEN {turned} END"))
    around = """aggregate(sequence(1, n - 1), 0D,
        (s, k) -> s + (p[k].x - p[0].x) * (p[k + 1].y - p[0].y) - (p[k + 1].x - p[0].x) * (p[k].y - p[0].y))"""
    found = [
        (0, f"NOT ({closed})", PLACED.format("'ring is not closed'", *first)),
        (1, f"{closed} AND n < 3", PLACED.format("'ring has too few points'", *first)),
        (2, "back IS NOT NULL", PLACED.format("'ring doubles back on itself'", "get(p, back + 1).x", "get(p, back + 1).y")),
        (4, f"{closed} AND n >= 3 AND {around} = 0", PLACED.format("'ring encloses nothing'", *first)),
    ]
    kinds = F.array_compact(
        F.array(*[F.expr(f"CASE WHEN {when} THEN struct({kind} AS kind, {text} AS fault) END") for kind, when, text in found])
    )
    return ring.select("shape_key", "part", F.lit(0).alias("step"), "ring", F.explode(kinds).alias("f")).select(
        "shape_key", "part", "step", "ring", "f.kind", F.lit(0).alias("i"), F.lit(0).alias("j"), "f.fault"
    )


def _crossing_faults(edges: DataFrame) -> DataFrame:
    """Edges of one ring that touch without being neighbours, and edges of a hole that cross another ring of their part."""
    same = "a.part = b.part AND ((a.ring = b.ring AND b.i > a.i + 1 AND NOT (a.i = 0 AND b.i = a.n - 1)) OR a.ring <> b.ring)"
    near = " AND ".join(
        f"least(a.{c}1, a.{c}2) <= greatest(b.{c}1, b.{c}2) AND least(b.{c}1, b.{c}2) <= greatest(a.{c}1, a.{c}2)" for c in "xy"
    )
    met = ed.meeting(edges, ["shape_key"], ["part", "ring", "i"], f"{same} AND {near}").where(
        "CASE WHEN a.ring = b.ring THEN s1 * s2 <= 0 AND s3 * s4 <= 0 ELSE s1 * s2 < 0 AND s3 * s4 < 0 END"
    )
    at = [f"CASE WHEN s3 = s4 THEN b.{c}1 ELSE a.{c}1 + s3 / (s3 - s4) * (a.{c}2 - a.{c}1) END" for c in "xy"]
    return met.select(
        "shape_key", "a.part", F.when(F.expr("a.ring = b.ring"), 0).otherwise(1).alias("step"), "b.ring", F.lit(3).alias("kind"),
        F.col("a.i").alias("i"), F.col("b.i").alias("j"),
        F.when(F.expr("a.ring = b.ring"), F.expr(PLACED.format("'outline crosses itself'", *at)))
        .otherwise(F.expr(PLACED.format("'hole lies outside its shell'", *at))).alias("fault"),
    )


def _looked_faults(looks: DataFrame) -> DataFrame:
    """The same faults of shapes of few edges, whose crossings were found within their rows."""
    at = looks.select("shape_key", F.explode("look.crossings").alias("c")).select("shape_key", "c.*")
    said = "CASE WHEN step = 0 THEN {0} ELSE {1} END".format(
        PLACED.format("'outline crosses itself'", "x", "y"), PLACED.format("'hole lies outside its shell'", "x", "y")
    )
    return at.select("shape_key", "part", "step", "ring", F.lit(3).alias("kind"), "i", "j", F.expr(said).alias("fault"))


def _hole_faults(rings: DataFrame, edges: DataFrame) -> DataFrame:
    """Points of holes that are neither inside their part's outline nor on it."""
    point = rings.where("ring > 0").select("shape_key", "part", "ring", F.posexplode("points").alias("i", "at"))
    key = ["shape_key", "part", "ring", "i"]
    point = point.select(*key, *[F.col(f"at.{c}").alias(f"{m}{c}") for c in "xy" for m in ("min", "max")])
    beside = ed.beside(point, edges.where("ring = 0").drop("ring", "i", "n"), ["shape_key", "part"])
    inside = beside.groupBy(*key).agg(
        F.count_if(ed.left_of("minx", "miny")).alias("left"), F.min(ed.distance_to("minx", "miny")).alias("away")
    )
    lost = sized_join(point, inside.where(f"left % 2 = 1 OR away <= {ed.ON_EDGE}"), key, "left_anti")
    return lost.select(
        "shape_key", "part", F.lit(1).alias("step"), "ring", F.lit(0).alias("kind"), "i", F.lit(0).alias("j"),
        F.expr(PLACED.format("'hole lies outside its shell'", "minx", "miny")).alias("fault"),
    )


def _part_faults(edges: DataFrame) -> DataFrame:
    """Shapes of several parts that share ground."""
    several = edges.groupBy("shape_key").agg(F.max("part").alias("last")).where("last > 0")
    parts = sized_join(edges, several, ["shape_key"], "left_semi").distinct()
    swept = ed.swept(parts.withColumns({"owner": F.col("part").cast("long"), "of_b": F.lit(False)}), ["shape_key"])
    return swept.where(f"twice > {ed.ON_EDGE}").select(
        "shape_key", F.lit(2**31 - 1).alias("part"), *[F.lit(0).alias(c) for c in ("step", "ring", "kind", "i", "j")],
        F.expr(PLACED.format("'parts overlap'", "twice_at.x", "twice_at.y")).alias("fault"),
    )


def shape_faults(features: DataFrame) -> DataFrame:
    """shape_key, fault: the first fault of each illegal area shape, with its place.

    Shapes that are plainly legal are done with in one look. Of all others rings are looked at in order, then their part's
    holes, then how parts lie. Shapes of few edges are compared within their rows. Edges of all others meet in grid cells of their own shape, so the work follows the number of edges, and a huge shape is
    spread over its cells. Boxes cannot be illegal.
    """
    shapes = features.where((F.col("status") == "ok") & F.col("kind").isin(*AREAL) & ~F.col("is_box"))
    shapes = written(shapes.where(~plainly_legal("geometry")).select("shape_key", "geometry"), "doubtful-shapes")
    rings = written(ed.ring_rows(shapes, ["shape_key"]), "rings")
    if rings.isEmpty():
        return rings.select("shape_key", F.lit("").alias("fault"))
    edges = written(ed.edges_of(rings, ["shape_key"]), "edges")
    looks = written(shapes.select("shape_key", few_edges_look("geometry").alias("look")), "looks")
    found = [_ring_faults(rings), _looked_faults(looks), _hole_faults(rings, edges)]
    for left, faults in (("look.crossings IS NULL", _crossing_faults), ("NOT coalesce(look.apart, false)", _part_faults)):
        asked = written(looks.where(left).select("shape_key").distinct(), "shapes-by-edges")
        if not asked.isEmpty():
            found.append(faults(keyed_join(edges, asked, ["shape_key"], "left_semi")))
    found = union(found)
    rank = F.struct("part", "step", "ring", "kind", "i", "j")
    return found.groupBy("shape_key").agg(F.min_by("fault", rank).alias("fault"))


def with_faults(features: DataFrame) -> DataFrame:
    """Features with ``fault``, null for legal shapes; ``features`` should be written, since they are read twice."""
    return keyed_join(features, written(shape_faults(features), "faults"), ["shape_key"])


def legal_shape_rules(features: DataFrame) -> DataFrame:
    """Every illegal boundary and parcel with its fault. ``features`` may have their ``fault`` already."""
    if "fault" not in features.columns:
        told = features.where(F.col("layer").isin(REDLINE, HABITATS) & (F.col("status") == "ok") & F.col("kind").isin(*AREAL) & ~F.col("is_box"))
        features = with_faults(written(told.select(*SITE, "layer", "feature_ref", "shape_key", "geometry", "status", "kind", "is_box"), "decoded"))
    faulty = features.where(F.col("fault").isNotNull() & F.col("layer").isin(REDLINE, HABITATS))
    code = F.when(F.col("layer") == REDLINE, "REDLINE_INVALID_GEOMETRY").otherwise("AREA_PARCELS_INVALID_GEOMETRY")
    return violation(faulty, LEGAL, code, F.col("layer"), F.col("feature_ref"), F.col("fault"))


def reported(violations: DataFrame, per_code: int) -> DataFrame:
    """A report's view: the first ``per_code`` features of each site and code.

    The filter on the row number lets Spark keep only the first rows per site before the shuffle.
    """
    order = Window.partitionBy(*SITE, "code").orderBy("feature_ref", "detail")
    return violations.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_code).drop("nth")
