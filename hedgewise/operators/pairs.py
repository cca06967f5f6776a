"""Checks that a site's baseline and post-intervention submissions agree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewise.functions.scalars import parent_ref, summary_label
from hedgewise.plans import sized_join
from hedgewise.schema import LAYER_TABLES, REF_COLUMNS, RETENTION, cleared_columns

FAILURE_COLUMNS = ("site_id", "check", "layer", "ref", "rows", "message")

# Text of a failed redline comparison.
REDLINE_MISSING = "Red Line Boundary missing in one file"
REDLINE_GEOMETRY = "Red Line Boundary geometry differs between baseline and post-intervention"


def populated(layer: str, columns: list[str]) -> Column:
    """Whether any proposed column or the retention of a baseline row has a value."""
    found = F.lit(False)
    for name in cleared_columns(layer):
        if name in columns:
            found = found | F.col(name).isNotNull()
    return found


def derive_baseline(post: DataFrame, layer: str) -> DataFrame:
    """Post-intervention rows with the proposed state cleared; geometry and refs stay."""
    kinds = dict(post.dtypes)
    cleared = {c: F.lit(None).cast(kinds[c]) for c in cleared_columns(layer) if c in kinds}
    return post.withColumns(cleared)


def cleared_rows(post: DataFrame, layer: str) -> DataFrame:
    """How many rows per site and layer lose a proposed value when the baseline is derived."""
    return post.groupBy("site_id").agg(
        F.lit(LAYER_TABLES[layer]).alias("layer"), F.count_if(populated(layer, post.columns)).alias("cleared")
    )


def leaked_rows(baseline: DataFrame, layer: str) -> DataFrame:
    """Sites whose baseline rows carry proposed values."""
    table = LAYER_TABLES[layer]
    counts = baseline.groupBy("site_id").agg(F.count_if(populated(layer, baseline.columns)).alias("rows"))
    return counts.where(F.col("rows") > 0).select(
        "site_id",
        F.lit("baseline_nulls").alias("check"),
        F.lit(table).alias("layer"),
        F.lit(None).cast("string").alias("ref"),
        "rows",
        F.format_string(f"{table}: %d row(s) have populated Proposed/Retention columns", "rows").alias("message"),
    )


def first_redline(redline: DataFrame) -> DataFrame:
    """The site's first boundary row, by row id where there is one."""
    order = "fid" if "fid" in redline.columns else "area_m2"
    return redline.groupBy("site_id").agg(
        F.min_by(F.struct("geometry", "area_m2"), order).alias("line")
    ).select("site_id", "line.*")


def redline_differences(baseline: DataFrame, post: DataFrame) -> DataFrame:
    """Sites whose two boundaries are missing or differ; a missing side is named first."""
    before = first_redline(baseline).select(
        "site_id", F.col("geometry").alias("g0"), F.col("area_m2").alias("a0"), F.lit(True).alias("in_base")
    )
    after = first_redline(post).select(
        "site_id", F.col("geometry").alias("g1"), F.col("area_m2").alias("a1"), F.lit(True).alias("in_post")
    )
    message = (
        F.when(F.col("in_base").isNull() | F.col("in_post").isNull(), REDLINE_MISSING)
        .when(~F.col("g0").eqNullSafe(F.col("g1")), REDLINE_GEOMETRY)
        .when(
            ~F.col("a0").eqNullSafe(F.col("a1")),
            F.concat(
                F.lit("Red Line Boundary area differs: baseline="), F.coalesce(F.col("a0").cast("string"), F.lit("null")),
                F.lit(" post="), F.coalesce(F.col("a1").cast("string"), F.lit("null")),
            ),
        )
    )
    return (
        sized_join(before, after, ["site_id"], "full")
        .withColumn("message", message)
        .where(F.col("message").isNotNull())
        .select(
            "site_id",
            F.lit("redline").alias("check"),
            F.lit(LAYER_TABLES["redline"]).alias("layer"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(1).cast("long").alias("rows"),
            "message",
        )
    )


def untraced_refs(baseline: DataFrame, post: DataFrame, layer: str) -> DataFrame:
    """Post-intervention refs found in the baseline neither as they are nor without their letter.

    Rows are counted per ref before the anti joins, so a ref repeated over many rows is
    one row from there on.
    """
    table, ref = LAYER_TABLES[layer], REF_COLUMNS[layer]
    known = baseline.select("site_id", F.col(ref).alias("known")).where("known IS NOT NULL").distinct()
    created = F.coalesce(F.col(RETENTION) == "Created", F.lit(False))
    wanted = (
        post.where(F.col(ref).isNotNull() & (F.col(ref) != "") & ~created)
        .groupBy("site_id", F.col(ref).alias("ref"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    lost = sized_join(wanted, known.withColumnRenamed("known", "ref"), ["site_id", "ref"], "left_anti")
    lost = sized_join(lost.withColumn("known", parent_ref(F.col("ref"))), known, ["site_id", "known"], "left_anti")
    return lost.select(
        "site_id",
        F.lit("refs").alias("check"),
        F.lit(table).alias("layer"),
        "ref",
        "rows",
        F.format_string(f'{table}: post-intervention ref "%s" has no matching baseline ref', "ref").alias("message"),
    )


def pair_failures(
    baseline: Mapping[str, DataFrame], post: Mapping[str, DataFrame]
) -> DataFrame:
    """All failed checks of all pairs; the mappings hold ``redline`` and any feature layers."""
    found = redline_differences(baseline["redline"], post["redline"])
    for layer in REF_COLUMNS:
        if layer in baseline:
            found = found.unionByName(leaked_rows(baseline[layer], layer))
        if layer in baseline and layer in post:
            found = found.unionByName(untraced_refs(baseline[layer], post[layer], layer))
    return found


def pair_summary(pairs: DataFrame, failures: DataFrame) -> DataFrame:
    """Pairs checked and passed, with the ``passed/total`` label."""
    failed = failures.select("site_id").distinct().withColumn("failed", F.lit(True))
    return (
        sized_join(pairs.select("site_id").distinct(), failed, ["site_id"], "left")
        .agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("failed").isNull()).alias("passed"))
        .withColumn("label", summary_label(F.col("passed"), F.col("checked")))
    )


def file_pairs(files: DataFrame, name: str = "name") -> DataFrame:
    """Complete baseline / post-intervention file pairs by base name and timestamp."""
    pattern = r"^(.+)-(baseline|post-intervention)-(\d{8}-\d{4}-\d{2})\.gpkg$"
    parts = files.select(
        name,
        F.regexp_extract(name, pattern, 1).alias("base"),
        F.regexp_extract(name, pattern, 2).alias("side"),
        F.regexp_extract(name, pattern, 3).alias("stamp"),
    ).where("side <> ''")
    return (
        parts.groupBy("base", "stamp")
        .agg(
            F.max(F.when(F.col("side") == "baseline", F.col(name))).alias("baseline_file"),
            F.max(F.when(F.col("side") == "post-intervention", F.col(name))).alias("post_file"),
        )
        .where("baseline_file IS NOT NULL AND post_file IS NOT NULL")
    )
