"""Metric-workbook sheet rows turned into feature rows.

Every sheet row carries its ``site_id`` and, where order matters, its position
``row_no`` on the sheet. The number of slices of a parcel follows from its own fate
columns, so splitting needs no window; only the pairing of lost parcels with created
ones is by position within a site.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewise.functions.scalars import layer_ref
from hedgewise.operators.pricing import CREATED, ENHANCED, RETAINED
from hedgewise.plans import keyed_join, sized_join, written

ATTRIBUTES = {
    "habitats": ["broad", "type", "distinctiveness", "condition", "strategic_significance"],
    "hedgerows": ["type", "distinctiveness", "condition", "strategic_significance"],
    "rivers": ["type", "distinctiveness", "condition", "strategic_significance"],
    "trees": ["type", "distinctiveness", "condition", "strategic_significance"],
}
SIZES = {
    "habitats": ("area", "area_retained", "area_enhanced", "area_lost"),
    "hedgerows": ("length_m", "length_retained_m", "length_enhanced_m", "length_lost_m"),
    "rivers": ("length_m", "length_retained_m", "length_enhanced_m", "length_lost_m"),
    "trees": (None, "area_retained", "area_enhanced", "area_lost"),
}
YEARS = ["advance_years", "delay_years"]

# Adds a 1-based position per site; the caller chooses one that suits its data's skew.
Ranker = Callable[[DataFrame, str], DataFrame]


def baseline_rows(sheet: DataFrame, layer: str) -> DataFrame:
    """Baseline feature rows: formatted ref, source ref as text, no proposed columns."""
    size = SIZES[layer][0]
    return sheet.select(
        "site_id",
        layer_ref(layer, F.col("ref")).alias("ref"),
        F.col("ref").cast("string").alias("baseline_ref"),
        *([size] if size else []),
        *ATTRIBUTES[layer],
    )


def strict_habitats(sheet: DataFrame, metric: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Habitat rows the metric table knows, and a reason for each one it does not.

    ``metric`` has one row per valid (broad, type, condition).
    """
    key = ["broad", "type", "condition"]
    marked = keyed_join(sheet, metric.select(*key).distinct().withColumn("valid", F.lit(True)), key)
    kept = marked.where("valid").drop("valid").select(*sheet.columns)
    skipped = marked.where("valid IS NULL").select(
        "site_id",
        "ref",
        F.format_string(
            "Skipped habitat ref %d: '%s - %s' in condition '%s' is not in the metric", "ref", *key
        ).alias("reason"),
    )
    return kept, skipped


def _named(prefix: str, attributes: list[str], source: str | None = None) -> list[Column]:
    return [F.col(f"{source}_{a}" if source else a).alias(f"{prefix}_{a}") for a in attributes]


def _number(value: str) -> Column:
    return F.coalesce(F.col(value), F.lit(0.0))


def sliced_rows(
    baseline: DataFrame, enhancements: DataFrame | None, layer: str, paired: DataFrame | None = None
) -> DataFrame:
    """Retained, enhanced and (for paired lost parcels) created slices of each baseline row.

    ``paired`` gives created attributes per (site_id, ref) of a lost parcel.
    """
    attributes = ATTRIBUTES[layer]
    size, retained, enhanced, lost = SIZES[layer]
    key = ["site_id", "ref"]
    rows = baseline
    if enhancements is not None:
        target = enhancements.select(
            "site_id", F.col("baseline_ref").alias("ref"),
            *[F.col(f"proposed_{a}").alias(f"enh_{a}") for a in attributes],
            *[F.col(y).alias(f"enh_{y}") for y in YEARS],
        )
        rows = keyed_join(rows, target, key)
    else:
        rows = rows.withColumns({f"enh_{a}": F.lit(None).cast("string") for a in attributes})
        rows = rows.withColumns({f"enh_{y}": F.lit(None).cast("int") for y in YEARS})
    if paired is not None:
        rows = keyed_join(rows, paired, key)

    def slice_of(when: Column, retention: str, amount: Column, source: str | None) -> Column:
        fields = [F.lit(retention).alias("retention"), amount.cast("double").alias("amount")]
        fields += _named("prop", attributes, source)
        fields += [
            (F.col(f"{source}_{y}") if source else F.lit(None)).cast("int").alias(y) for y in YEARS
        ]
        return F.when(when, F.struct(*fields))

    whole = _number(size) if size else F.lit(1.0)
    no_fate = (_number(retained) == 0) & (_number(enhanced) == 0) & (_number(lost) == 0)
    keeps_all = no_fate if layer in ("hedgerows", "rivers") else F.lit(False)
    kept_amount = F.when(keeps_all, whole).otherwise(_number(retained))
    slices = [
        slice_of((_number(retained) > 0) | keeps_all, RETAINED, kept_amount, None),
        slice_of(_number(enhanced) > 0, ENHANCED, _number(enhanced), "enh"),
    ]
    if paired is not None:
        slices.append(slice_of(F.col("new_size").isNotNull(), CREATED, F.col("new_size"), "new"))
    rows = rows.withColumn("slices", F.array_compact(F.array(*slices)))
    count = F.size("slices")
    return (
        rows.select(
            "site_id", "ref", *_named("base", attributes), count.alias("slice_count"),
            F.posexplode("slices").alias("slice_no", "slice"),
        )
        .withColumn("letter", F.when(F.col("slice_count") > 1, F.char(F.col("slice_no") + ord("a"))).otherwise(""))
        .select(
            "site_id",
            F.concat(layer_ref(layer, F.col("ref")), F.col("letter")).alias("ref"),
            F.col("ref").cast("string").alias("baseline_ref"),
            F.col("slice.retention").alias("retention"),
            F.col("slice.amount").alias("amount"),
            *[F.col(f"base_{a}") for a in attributes],
            *[F.col(f"slice.prop_{a}") for a in attributes],
            *[F.col(f"slice.{y}") for y in YEARS],
        )
    )


def fresh_rows(created: DataFrame, number: Column, layer: str) -> DataFrame:
    """Created rows without a parcel of their own: fresh ref, baseline copied from themselves."""
    attributes = ATTRIBUTES[layer]
    size = SIZES[layer][0]
    return created.select(
        "site_id",
        layer_ref(layer, number).alias("ref"),
        F.lit(None).cast("string").alias("baseline_ref"),
        F.lit(CREATED).alias("retention"),
        (F.col(size) if size else F.lit(1.0)).cast("double").alias("amount"),
        *_named("base", attributes),
        *_named("prop", attributes),
        *[F.col(y).cast("int").alias(y) for y in YEARS],
    )


def baseline_counts(baseline: DataFrame) -> DataFrame:
    return baseline.groupBy("site_id").agg(F.count(F.lit(1)).alias("baseline_count"))


def post_rows(
    baseline: DataFrame,
    created: DataFrame,
    enhancements: DataFrame | None,
    layer: str,
    rank: Ranker,
) -> DataFrame:
    """All post-intervention rows of a layer.

    Habitats pair the k-th lost parcel of a site with its k-th created row; created rows
    beyond the lost ones, and all created rows of the other layers, get fresh refs that
    continue after the baseline count.
    """
    counts = baseline_counts(baseline)
    ranked = rank(created, "created_no")
    if layer != "habitats":
        fresh = keyed_join(ranked, counts, ["site_id"])
        number = F.coalesce("baseline_count", F.lit(0)) + F.col("created_no")
        return sliced_rows(baseline, enhancements, layer).unionByName(fresh_rows(fresh, number, layer))
    gone = rank(baseline.where(F.coalesce("area_lost", F.lit(0.0)) > 0), "lost_no").select(
        "site_id", F.col("lost_no").alias("created_no"), F.col("ref").alias("parcel")
    )
    # read for the pairs and for what is left over
    matched = written(sized_join(ranked, gone, ["site_id", "created_no"], "left"), "matched-rows")
    attributes = ATTRIBUTES[layer]
    paired = matched.where("parcel IS NOT NULL").select(
        "site_id", F.col("parcel").alias("ref"), F.col("area").alias("new_size"),
        *_named("new", attributes), *[F.col(y).alias(f"new_{y}") for y in YEARS],
    )
    lost_counts = baseline.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("baseline_count"),
        F.count_if(F.coalesce("area_lost", F.lit(0.0)) > 0).alias("lost_count"),
    )
    left_over = keyed_join(matched.where("parcel IS NULL").drop("parcel"), lost_counts, ["site_id"])
    number = (
        F.coalesce("baseline_count", F.lit(0)) + F.col("created_no") - F.coalesce("lost_count", F.lit(0))
    )
    return sliced_rows(baseline, enhancements, layer, paired).unionByName(fresh_rows(left_over, number, layer))


def stage_rows(baseline: DataFrame, post: DataFrame, mode: str = "both") -> DataFrame:
    """Rows of the requested stage or of both, told apart by ``stage``."""
    first = baseline.withColumn("stage", F.lit("baseline"))
    second = post.withColumn("stage", F.lit("post-intervention"))
    if mode == "baseline":
        return first
    if mode == "post-intervention":
        return second
    return first.unionByName(second, allowMissingColumns=True)


def sheet_counts(sheets: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Row counts per site, one column per (layer, stage) sheet."""
    union = None
    for (layer, stage), sheet in sheets.items():
        part = sheet.groupBy("site_id").agg(F.count(F.lit(1)).alias("rows")).withColumn(
            "sheet", F.lit(f"{layer}_{stage}")
        )
        union = part if union is None else union.unionByName(part)
    names = [f"{layer}_{stage}" for layer, stage in sheets]
    wide = union.groupBy("site_id").pivot("sheet", names).agg(F.sum("rows"))
    return wide.na.fill(0, names)
