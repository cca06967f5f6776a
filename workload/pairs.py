"""Baseline / post-intervention pair queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hedgewise.operators import pairs as op
from hedgewise.schema import PROPOSED_COLUMNS
from workload import sql as q
from workload import tables as t
from workload.registry import query

HABITAT_COLUMNS = ["site_id", "n", "parcel_ref", *PROPOSED_COLUMNS["habitats"], "retention"]


def stages(spark, folder):
    """Both stages of the habitats layer and of the boundary, with planted faults."""
    placed = t.placed(t.parcels(spark, folder)).withColumns(
        {
            "prop_strategic_sig": F.lit("Low"),
            "prop_distinctiveness": t.pick(["Low", "Medium", "High"], F.col("l_partkey") % 3),
        }
    ).select(*HABITAT_COLUMNS)
    suffix = t.pick(["", "a", "b"], F.col("n") % 3)
    retention = F.when(F.col("n") % 7 == 0, "Created").otherwise(F.col("retention"))
    post = placed.withColumns(
        {"parcel_ref": F.concat("parcel_ref", suffix), "retention": retention}
    )
    cleared = op.derive_baseline(placed, "habitats")
    base = cleared.withColumns(
        {
            "parcel_ref": F.when(F.col("site_id") % 11 != 0, F.col("parcel_ref")),
            "prop_condition": F.when((F.col("site_id") % 13 == 0) & (F.col("n") == 1), "Good"),
        }
    )
    counts = t.load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("site_id")).agg(
        F.count(F.lit(1)).alias("parcels")
    )

    def outline(tag):
        return F.concat(F.lit("R"), F.col("site_id").cast("string"), F.lit(":"), F.col("parcels").cast("string"), tag)

    line = counts.withColumn("area_m2", F.col("parcels") * 5000.0)
    red_base = line.where("site_id % 23 <> 0").select(
        "site_id", outline(F.lit("")).cast("binary").alias("geometry"), "area_m2"
    )
    moved = F.when(F.col("site_id") % 19 == 0, "x").otherwise("")
    red_post = line.select(
        "site_id",
        outline(moved).cast("binary").alias("geometry"),
        F.when(F.col("site_id") % 17 == 0, F.col("area_m2") + 0.5).otherwise(F.col("area_m2")).alias("area_m2"),
    )
    return {"redline": red_base, "habitats": base}, {"redline": red_post, "habitats": post}


STAGES = f"""
WITH {q.PARCELS},
placed AS (SELECT site_id, n, parcel_ref, prop_broad, prop_type, prop_condition, retention FROM parcels),
post AS (
  SELECT site_id, n, parcel_ref || (['', 'a', 'b'])[CAST(n % 3 AS INTEGER) + 1] AS parcel_ref,
    CASE WHEN n % 7 = 0 THEN 'Created' ELSE retention END AS retention FROM placed),
base AS (
  SELECT site_id, n, CASE WHEN site_id % 11 <> 0 THEN parcel_ref END AS parcel_ref,
    CASE WHEN site_id % 13 = 0 AND n = 1 THEN 'Good' END AS prop_condition FROM placed),
lines AS (SELECT l_orderkey AS site_id, count(*) AS parcels, count(*) * 5000.0 AS area_m2 FROM lineitem GROUP BY 1),
red_base AS (SELECT site_id, 'R' || site_id || ':' || parcels AS g, area_m2 FROM lines WHERE site_id % 23 <> 0),
red_post AS (
  SELECT site_id, 'R' || site_id || ':' || parcels || CASE WHEN site_id % 19 = 0 THEN 'x' ELSE '' END AS g,
    CASE WHEN site_id % 17 = 0 THEN area_m2 + 0.5 ELSE area_m2 END AS area_m2 FROM lines),
leaks AS (
  SELECT site_id, 'baseline_nulls' AS "check", 'Habitats' AS layer, CAST(NULL AS VARCHAR) AS ref, count(*) AS rows,
    'Habitats: ' || count(*) || ' row(s) have populated Proposed/Retention columns' AS message
  FROM base WHERE prop_condition IS NOT NULL GROUP BY site_id),
reds AS (
  SELECT coalesce(b.site_id, p.site_id) AS site_id, 'redline' AS "check", 'Red Line Boundary' AS layer,
    CAST(NULL AS VARCHAR) AS ref, CAST(1 AS BIGINT) AS rows,
    CASE WHEN b.site_id IS NULL OR p.site_id IS NULL THEN 'Red Line Boundary missing in one file'
         WHEN b.g <> p.g THEN 'Red Line Boundary geometry differs between baseline and post-intervention'
         WHEN b.area_m2 <> p.area_m2 THEN 'Red Line Boundary area differs: baseline='
           || CAST(CAST(b.area_m2 AS DOUBLE) AS VARCHAR) || ' post=' || CAST(CAST(p.area_m2 AS DOUBLE) AS VARCHAR) END AS message
  FROM red_base b FULL JOIN red_post p ON b.site_id = p.site_id),
lost AS (
  SELECT site_id, parcel_ref, count(*) AS rows FROM post p
  WHERE retention <> 'Created'
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.site_id = p.site_id AND b.parcel_ref = p.parcel_ref)
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.site_id = p.site_id
                    AND b.parcel_ref = regexp_replace(p.parcel_ref, '[A-Za-z]$', ''))
  GROUP BY 1, 2),
refs AS (
  SELECT site_id, 'refs' AS "check", 'Habitats' AS layer, parcel_ref AS ref, rows,
    'Habitats: post-intervention ref "' || parcel_ref || '" has no matching baseline ref' AS message FROM lost),
failures AS (
  SELECT * FROM reds WHERE message IS NOT NULL UNION ALL SELECT * FROM leaks UNION ALL SELECT * FROM refs)
"""


@query("pair_check_failures", f"{STAGES} SELECT * FROM failures")
def pair_check_failures(spark, folder):
    return op.pair_failures(*stages(spark, folder))


@query(
    "pair_check_summary",
    f"""{STAGES}
SELECT count(*) AS checked, count(*) FILTER (f.site_id IS NULL) AS passed,
  count(*) FILTER (f.site_id IS NULL) || '/' || count(*) || ' pair(s) passed' AS label
FROM lines l LEFT JOIN (SELECT DISTINCT site_id FROM failures) f ON f.site_id = l.site_id""",
)
def pair_check_summary(spark, folder):
    base, post = stages(spark, folder)
    return op.pair_summary(post["redline"], op.pair_failures(base, post))


@query(
    "baseline_leakage",
    f'{STAGES} SELECT site_id, layer, rows, message FROM leaks',
)
def baseline_leakage(spark, folder):
    base, _ = stages(spark, folder)
    return op.leaked_rows(base["habitats"], "habitats").select("site_id", "layer", "rows", "message")


@query("redline_differences", f'{STAGES} SELECT site_id, message FROM reds WHERE message IS NOT NULL')
def redline_differences(spark, folder):
    base, post = stages(spark, folder)
    return op.redline_differences(base["redline"], post["redline"]).select("site_id", "message")


@query("untraced_refs", f"{STAGES} SELECT site_id, ref, rows, message FROM refs")
def untraced_refs(spark, folder):
    base, post = stages(spark, folder)
    found = op.untraced_refs(base["habitats"], post["habitats"], "habitats")
    return found.select("site_id", "ref", "rows", "message")


@query(
    "derived_baseline_cleared_rows",
    f"""WITH {q.PARCELS}
SELECT site_id, 'Habitats' AS layer, count(*) FILTER (prop_condition IS NOT NULL OR retention IS NOT NULL) AS cleared
FROM parcels GROUP BY site_id""",
)
def cleared_rows(spark, folder):
    return op.cleared_rows(t.parcels(spark, folder), "habitats")


@query(
    "derived_baseline_rows",
    f"""WITH {q.PARCELS}
SELECT site_id, l_linenumber, l_partkey, l_suppkey, parcel_ref, base_type, CAST(NULL AS VARCHAR) AS prop_type,
  CAST(NULL AS VARCHAR) AS retention FROM parcels""",
)
def derived_baseline(spark, folder):
    return op.derive_baseline(t.parcels(spark, folder), "habitats").select(
        "site_id", "l_linenumber", "l_partkey", "l_suppkey", "parcel_ref", "base_type", "prop_type", "retention"
    )


FILES = """
SELECT 'site-' || (o_orderkey // 3) || '-' || (CASE o_orderkey % 3 WHEN 0 THEN 'baseline'
    WHEN 1 THEN 'post-intervention' ELSE 'notes' END) || '-' || strftime(o_orderdate, '%Y%m%d-%H%M-%S') || '.gpkg' AS name
FROM orders
UNION ALL
SELECT 'pair-' || o_orderkey || '-' || s.side || '-' || strftime(o_orderdate, '%Y%m%d-%H%M-%S') || '.gpkg'
FROM orders CROSS JOIN (VALUES ('baseline'), ('post-intervention')) AS s(side) WHERE o_orderkey % 5 <> 0 OR s.side = 'baseline'
"""


@query(
    "file_pairs",
    f"""WITH files AS ({FILES}), parts AS (
  SELECT name, regexp_extract(name, '^(.+)-(baseline|post-intervention)-(\\d{{8}}-\\d{{4}}-\\d{{2}})\\.gpkg$', 1) AS base,
    regexp_extract(name, '^(.+)-(baseline|post-intervention)-(\\d{{8}}-\\d{{4}}-\\d{{2}})\\.gpkg$', 2) AS side,
    regexp_extract(name, '^(.+)-(baseline|post-intervention)-(\\d{{8}}-\\d{{4}}-\\d{{2}})\\.gpkg$', 3) AS stamp FROM files)
SELECT base, stamp, max(name) FILTER (side = 'baseline') AS baseline_file,
  max(name) FILTER (side = 'post-intervention') AS post_file
FROM parts WHERE side <> '' GROUP BY 1, 2
HAVING count(*) FILTER (side = 'baseline') > 0 AND count(*) FILTER (side = 'post-intervention') > 0""",
)
def file_pairs(spark, folder):
    orders = t.load(spark, folder, "orders")
    stamp = F.concat(F.lit("-"), F.date_format("o_orderdate", "yyyyMMdd-HHmm-ss"), F.lit(".gpkg"))
    key = F.col("o_orderkey")
    side = F.when(key % 3 == 0, "baseline").when(key % 3 == 1, "post-intervention").otherwise("notes")
    third = F.floor(key / 3).cast("string")
    single = orders.select(F.concat(F.lit("site-"), third, F.lit("-"), side, stamp).alias("name"))
    sides = F.when(key % 5 != 0, F.array(F.lit("baseline"), F.lit("post-intervention"))).otherwise(
        F.array(F.lit("baseline"))
    )
    double = orders.withColumn("side", F.explode(sides)).select(
        F.concat(F.lit("pair-"), key.cast("string"), F.lit("-"), "side", stamp).alias("name")
    )
    return op.file_pairs(single.unionByName(double))
