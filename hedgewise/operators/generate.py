"""Deterministic test sites: every value follows from (seed, site, row, column), never from
how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewise.functions.geometry import box_wkb, line_wkb, point_wkb
from hedgewise.functions.scalars import layer_ref
from hedgewise.operators.pricing import LOST, RETAINED
from hedgewise.plans import keyed_join, sized_join
from hedgewise.schema import LAYER_TABLES

PARCEL_WIDTH, SITE_HEIGHT = 100.0, 50.0
FEATURE_COLUMNS = [
    "site_id", "layer", "feature_id", "feature_ref", "retention",
    "base_name", "base_condition", "prop_name", "prop_condition", "advance_raw", "delay_raw", "geometry",
]

# The flaws a site can be given.
GEOMETRIC_FLAWS = (
    "self-intersecting-redline", "bowtie-parcel", "overlapping-parcels", "parcel-outside-redline",
    "parcel-too-small", "area-sum-mismatch", "hedgerow-outside", "watercourse-outside", "tree-outside",
    "iggi-outside", "redline-not-in-england", "redline-too-large", "tiny-gap",
)
EMPTY_LAYER_FLAWS = {
    "no-habitats": LAYER_TABLES["habitats"], "no-hedgerows": LAYER_TABLES["hedgerows"],
    "no-rivers": LAYER_TABLES["rivers"], "no-trees": LAYER_TABLES["trees"],
}
ATTRIBUTE_FLAWS = ("distinctiveness-out-of-scope", "duplicate-habitat-ref", "advance-delay-both-set")
FLAWS = (*GEOMETRIC_FLAWS, *EMPTY_LAYER_FLAWS, *ATTRIBUTE_FLAWS)


def drawn(seed: Column, row: Column, column: str, count: int) -> Column:
    """A number in 0..count-1 that depends on nothing but its arguments and the site."""
    return F.pmod(F.xxhash64(seed, F.col("site_id"), row, F.lit(column)), F.lit(count)).cast("int")


def scenario_seed(seed: Column | int, scenario_id: Column) -> Column:
    """A stable seed per scenario, whichever scenarios run with it."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.xxhash64(seed, scenario_id)


def layer_sizes(parcels: Column) -> dict[str, Column]:
    """How many features of each other layer a site of so many parcels gets."""
    return {
        "hedgerows": F.greatest(F.lit(3), F.floor(parcels / 3)),
        "rivers": F.greatest(F.lit(2), F.floor(parcels / 15)),
        "trees": F.greatest(F.lit(5), F.floor(parcels / 2)),
    }


def _numbered(sites: DataFrame, count: Column) -> DataFrame:
    """One row per feature number 1..count of each site; ``sites`` are spread over the cluster.

    Numbers of a site of very many features are laid out in blocks first, so it is cut into
    many rows before any row is expanded.
    """
    block = 4096
    counted = sites.withColumn("count", count.cast("long")).where(F.col("count") > 0)
    small = counted.where(F.col("count") <= block).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).drop("count")
    blocks = counted.where(F.col("count") > block)
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / block))))
    spread = blocks.repartition("site_id", "block")
    last = F.least(F.col("count"), (F.col("block") + 1) * block)
    return small.unionByName(spread.withColumn("n", F.explode(F.sequence(F.col("block") * block + 1, last))).drop("block", "count"))


def _name(catalogue: list[str], pick: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in catalogue]), pick)


def generate(
    sites: DataFrame, habitats: list[str], conditions: list[str], hedges: list[str], rivers: list[str],
    carried: Sequence[str] = (),
) -> DataFrame:
    """Features of all five layers for every row of ``sites`` (site_id, parcels, seed, x, y), with the ``carried`` columns of
    their site.

    One boundary per site, tiled exactly by its parcels; lines and points lie inside.
    """
    sites = sites.repartition("site_id")
    seed, n = F.col("seed"), F.col("n")
    x, y, parcels = F.col("x"), F.col("y"), F.col("parcels")
    sizes = layer_sizes(parcels)
    width = parcels * PARCEL_WIDTH
    text = F.lit(None).cast("string")

    redline = sites.select(
        "site_id", F.lit(LAYER_TABLES["redline"]).alias("layer"), F.lit(1).cast("long").alias("feature_id"),
        text.alias("feature_ref"), *[text.alias(c) for c in FEATURE_COLUMNS[4:-1]],
        box_wkb(x, y, x + width, y + SITE_HEIGHT).alias("geometry"), *carried,
    )

    def attributes(names: list[str], created: str) -> list[Column]:
        fate = drawn(seed, n, "retention", 3)
        base = _name(names, drawn(seed, n, "habitat", len(names)))
        condition = _name(conditions, drawn(seed, n, "condition", len(conditions)))
        better = _name(conditions, F.floor(drawn(seed, n, "condition", len(conditions)) / 2).cast("int"))
        return [
            F.when(fate == 0, RETAINED).when(fate == 1, "Enhanced").otherwise(created).alias("retention"),
            base.alias("base_name"),
            condition.alias("base_condition"),
            F.when(fate == 2, _name(names, drawn(seed, n, "proposed", len(names)))).otherwise(base).alias("prop_name"),
            F.when(fate == 0, condition).otherwise(better).alias("prop_condition"),
            F.lit("0").alias("advance_raw"),
            F.lit("0").alias("delay_raw"),
        ]

    def features(layer: str, count: Column, names: list[str], created: str, shape: Column) -> DataFrame:
        return _numbered(sites, count).select(
            "site_id", F.lit(LAYER_TABLES[layer]).alias("layer"), n.alias("feature_id"),
            layer_ref(layer, n).alias("feature_ref"), *attributes(names, created), shape.alias("geometry"), *carried,
        )

    at = x + F.pmod(n - 1, parcels) * PARCEL_WIDTH
    across = y + 1 + F.pmod(n * 7, F.lit(int(SITE_HEIGHT) - 2))
    tile = box_wkb(x + (n - 1) * PARCEL_WIDTH, y, x + n * PARCEL_WIDTH, y + SITE_HEIGHT)
    line = line_wkb(at + 1, across, at + PARCEL_WIDTH - 1, across)
    dot = point_wkb(at + PARCEL_WIDTH / 2, across)
    return (
        redline.unionByName(features("habitats", parcels, habitats, LOST, tile))
        .unionByName(features("hedgerows", sizes["hedgerows"], hedges, "Created", line))
        .unionByName(features("rivers", sizes["rivers"], rivers, "Created", line))
        .unionByName(features("trees", sizes["trees"], habitats, "Created", dot))
    )


def override_rows(features: DataFrame, overrides: DataFrame) -> DataFrame:
    """Apply attribute overrides to the n-th row of a layer; other rows stay as they are.

    ``overrides`` has site_id, layer, feature_id and any of ref, retention, base_name,
    base_condition, prop_name, prop_condition, advance_raw, delay_raw. A retained row
    mirrors its baseline to the proposed side. Only rows whose number lies between the
    overrides' own in their layer are shuffled; no other can have one.
    """
    names = ["feature_ref", *FEATURE_COLUMNS[4:-1]]
    given = [c for c in names if c in overrides.columns]
    key = ["site_id", "layer", "feature_id"]
    within = _numbers_within(overrides)
    whole, features = features, features.where(within)
    new = overrides.select(*key, *[F.col(c).alias(f"new_{c}") for c in given], F.lit(True).alias("pinned"))
    joined = sized_join(features, new, key, "left")
    joined = joined.withColumns({c: F.coalesce(f"new_{c}", F.col(c)) for c in given})
    mirrored = F.coalesce(F.col("pinned"), F.lit(False)) & (F.col("retention") == RETAINED)
    joined = joined.withColumns(
        {
            f"prop_{c}": F.when(mirrored, F.col(f"base_{c}")).otherwise(F.col(f"prop_{c}"))
            for c in ("name", "condition")
        }
    )
    return joined.select(*features.columns).unionByName(whole.where(~within))


def _numbers_within(overrides: DataFrame) -> Column:
    """Whether a row's number lies between the least and the greatest of the overrides in its layer."""
    known = list(LAYER_TABLES.values())
    layer = F.col("layer")
    of = [*[layer == name for name in known], ~layer.isin(*known)]
    bounds = overrides.agg(*[f(F.when(on, F.col("feature_id"))) for on in of for f in (F.min, F.max)]).first()
    within = F.lit(False)
    for k, on in enumerate(of):
        if bounds[2 * k] is not None:
            within = within | (on & F.col("feature_id").between(bounds[2 * k], bounds[2 * k + 1]))
    return F.coalesce(within, F.lit(False))


def pin_habitats(features: DataFrame, pins: DataFrame) -> DataFrame:
    """Pin the n-th parcel of a site to the n-th named habitat, retained.

    ``pins`` has site_id, pin_no and full_name; pin numbers start at 1.
    """
    rows = pins.select(
        "site_id", F.lit(LAYER_TABLES["habitats"]).alias("layer"), F.col("pin_no").cast("long").alias("feature_id"),
        F.col("full_name").alias("base_name"), F.lit(RETAINED).alias("retention"),
    )
    return override_rows(features, rows)


def flawed_sites(sites: DataFrame, flaws: DataFrame) -> DataFrame:
    """Sites moved off the country where their flaw asks for it; to be done before generating."""
    abroad = flaws.where("flaw = 'redline-not-in-england'").select("site_id", F.lit(True).alias("abroad"))
    moved = sized_join(sites, abroad, ["site_id"], "left")
    return moved.withColumn("x", F.when(F.col("abroad"), F.col("x") - 2e6).otherwise(F.col("x"))).drop("abroad")


#: Columns by which a flaw is planted, and what they are called on sites and features that carry them.
PLAN = {"flaw": "flaw", "parcels": "flaw_parcels", "x": "flaw_x", "y": "flaw_y"}


def _plan(flaws: DataFrame, sites: DataFrame) -> DataFrame:
    return sized_join(flaws, sites.select("site_id", "parcels", "x", "y"), ["site_id"])


def planned_sites(sites: DataFrame, flaws: DataFrame) -> DataFrame:
    """Sites with the flaws they get, for ``generate`` to carry: a join of sites, not of all their features."""
    plan = _plan(flaws, sites).select("site_id", *[F.col(c).alias(n) for c, n in PLAN.items()])
    return sized_join(sites, plan, ["site_id"], "left")


def inject_flaws(features: DataFrame, flaws: DataFrame, sites: DataFrame, out_of_scope: str) -> DataFrame:
    """Give each site in ``flaws`` (site_id, flaw) its flaw.

    A flaw rewrites columns of particular rows, adds a row, or empties a layer; sites
    without one pass through unchanged. ``sites`` is what the site was generated from.
    Features that carry the columns of ``planned_sites`` are not joined again.
    """
    if set(PLAN.values()) <= set(features.columns):
        rows = features.withColumnsRenamed({n: c for c, n in PLAN.items()})
        features = features.drop(*PLAN.values())
    else:
        rows = keyed_join(features, _plan(flaws, sites), ["site_id"])
    flaw, n, layer = F.coalesce("flaw", F.lit("")), F.col("feature_id"), F.col("layer")
    x, y, parcels = F.col("x"), F.col("y"), F.col("parcels")
    left, right = x + (n - 1) * PARCEL_WIDTH, x + n * PARCEL_WIDTH
    top, width = y + SITE_HEIGHT, parcels * PARCEL_WIDTH

    def on(name: str, key: str, first: int = 1):
        return (flaw == name) & (layer == LAYER_TABLES[key]) & (n == first)

    redline = on("self-intersecting-redline", "redline")
    far = x + width + 1000.0
    geometry = (
        F.when(redline, bowtie(x, y, x + width, top))
        .when(on("bowtie-parcel", "habitats"), bowtie(left, y, right, top))
        .when(on("overlapping-parcels", "habitats"), box_wkb(left, y, right + 1.0, top))
        .when(on("parcel-outside-redline", "habitats"), box_wkb(far, y, far + PARCEL_WIDTH, top))
        .when(on("area-sum-mismatch", "habitats"), box_wkb(left, y, right - 10.0, top))
        .when(on("tiny-gap", "habitats"), box_wkb(left, y, right - 0.0064, top))
        .when(on("hedgerow-outside", "hedgerows"), line_wkb(far, y, far + 10.0, y))
        .when(on("watercourse-outside", "rivers"), line_wkb(far, y, far + 10.0, y))
        .when(on("tree-outside", "trees"), point_wkb(far, y))
        .when(on("redline-too-large", "redline"), box_wkb(x, y, x + 20_000.0, y + 20_000.0))
        .otherwise(F.col("geometry"))
    )
    moved = rows.withColumn("geometry", geometry)
    small = rows.where(on("parcel-too-small", "habitats")).withColumns(
        {
            "feature_id": parcels + 1,
            "feature_ref": layer_ref("habitats", parcels + 1),
            "geometry": box_wkb(x + width - 0.2, y, x + width, y + 0.2),
        }
    )
    iggi = rows.where((flaw == "iggi-outside") & (layer == LAYER_TABLES["redline"])).withColumns(
        {"layer": F.lit("iggis"), "feature_ref": F.lit("I001"), "geometry": box_wkb(far, y, far + 10.0, top)}
    )
    emptied = F.lit(False)
    for name, table in EMPTY_LAYER_FLAWS.items():
        emptied = emptied | ((flaw == name) & (layer == table))
    kept = moved.where(~emptied).unionByName(small).unionByName(iggi)
    parcel = layer == LAYER_TABLES["habitats"]
    both_set = (flaw == "advance-delay-both-set") & parcel & (n == 1)
    wrong_band = (flaw == "distinctiveness-out-of-scope") & parcel & (n <= 2)
    changed = kept.withColumns(
        {
            "feature_ref": F.when((flaw == "duplicate-habitat-ref") & parcel & (n <= 2), "DUP-1").otherwise(F.col("feature_ref")),
            "retention": F.when(both_set, "Created").when(wrong_band, RETAINED).otherwise(F.col("retention")),
            "advance_raw": F.when(both_set, "2").otherwise(F.col("advance_raw")),
            "delay_raw": F.when(both_set, "3").otherwise(F.col("delay_raw")),
            "base_name": F.when(wrong_band, out_of_scope).otherwise(F.col("base_name")),
            "prop_name": F.when(wrong_band, out_of_scope).otherwise(F.col("prop_name")),
        }
    )
    return changed.select(*features.columns)


def bowtie(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A four-cornered outline whose sides cross in the middle."""
    corners = [(x0, y0), (x1, y1), (x1, y0), (x0, y1), (x0, y0)]
    head = F.lit(bytes.fromhex("01030000000100000005000000"))
    return F.concat(head, *[F.substring(point_wkb(x, y), 6, 16) for x, y in corners])
