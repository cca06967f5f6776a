"""Workbook-sheet queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hedgewise.operators import workbook as op
from hedgewise.plans import numbered, written
from workload import sql as q
from workload import tables as t
from workload.pricing import rounded
from workload.registry import query

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "area_m2"]


def rank(df, out):
    return numbered(
        df, ["site_id"], ORDER, out,
        {"line_slice": F.col("l_linenumber"), "part_slice": F.floor(F.col("l_partkey") / 4096)},
    )


def sheets(spark, folder, layer="habitats"):
    """Baseline, created and enhancement sheets of one layer, numbered once and stored."""
    numbers = t.placed(t.parcels(spark, folder).drop("advance_raw", "delay_raw", "retention"))
    rows = written(numbers, "sheet-rows").withColumns(
        {
            "ref": F.col("n").cast("int"),
            "broad": F.col("base_broad"),
            "type": F.col("base_type"),
            "condition": F.col("base_condition"),
            "distinctiveness": t.pick(["Low", "Medium", "High"], F.col("l_partkey") % 3),
            "strategic_significance": F.lit("Low"),
        }
    )
    fate = F.col("l_partkey") % 4
    size, retained, enhanced, lost = op.SIZES[layer]
    shares = {retained: [1.0, 0.4, 0.0, 0.0], enhanced: [0.0, 0.6, 1.0, 0.0], lost: [0.0, 0.0, 0.0, 1.0]}
    if layer in ("hedgerows", "rivers"):
        shares[lost] = [0.0, 0.0, 0.0, 0.0]
    base = rows.where("l_linenumber < 6").withColumns(
        {c: F.col("area_m2") * t.pick(v, fate) for c, v in shares.items()}
    )
    if size:
        base = base.withColumn(size, F.col("area_m2"))
    made = rows.where("l_linenumber >= 6").withColumns(
        {
            **({size: F.col("area_m2")} if size else {}),
            "broad": F.col("prop_broad"), "type": F.col("prop_type"), "condition": F.col("prop_condition"),
            "advance_years": F.lit(0), "delay_years": (F.col("l_suppkey") % 4).cast("int"),
        }
    )
    better = rows.where("l_linenumber < 6 AND l_partkey % 4 IN (1, 2) AND l_suppkey % 10 <> 0").select(
        "site_id", F.col("ref").alias("baseline_ref"),
        F.col("prop_broad").alias("proposed_broad"), F.col("prop_type").alias("proposed_type"),
        F.col("distinctiveness").alias("proposed_distinctiveness"),
        F.col("prop_condition").alias("proposed_condition"),
        F.lit("High").alias("proposed_strategic_significance"),
        (F.col("l_suppkey") % 3).cast("int").alias("advance_years"), F.lit(0).alias("delay_years"),
    )
    return base, made, better


SHEETS = f"""
WITH {q.PARCELS},
src AS (SELECT *, CAST(n AS INTEGER) AS ref,
  (['Low','Medium','High'])[CAST(l_partkey % 3 AS INTEGER) + 1] AS dist, l_partkey % 4 AS fate FROM parcels),
base AS (SELECT *, area_m2 * ([1.0,0.4,0.0,0.0])[CAST(fate AS INTEGER) + 1]::DOUBLE AS retained,
  area_m2 * ([0.0,0.6,1.0,0.0])[CAST(fate AS INTEGER) + 1]::DOUBLE AS enhanced,
  CASE WHEN fate = 3 THEN area_m2 ELSE 0.0 END AS lost FROM src WHERE l_linenumber < 6),
made AS (SELECT *, CAST(l_suppkey % 4 AS INTEGER) AS delay,
  row_number() OVER (PARTITION BY site_id ORDER BY l_linenumber, l_partkey, l_suppkey, area_m2) AS created_no
  FROM src WHERE l_linenumber >= 6),
better AS (SELECT site_id, ref, prop_broad, prop_type, prop_condition, dist, CAST(l_suppkey % 3 AS INTEGER) AS adv
  FROM src WHERE l_linenumber < 6 AND fate IN (1, 2) AND l_suppkey % 10 <> 0),
gone AS (SELECT site_id, ref, base_broad, base_type, base_condition, dist,
  row_number() OVER (PARTITION BY site_id ORDER BY l_linenumber, l_partkey, l_suppkey, area_m2) AS created_no
  FROM base WHERE lost > 0),
counts AS (SELECT site_id, count(*) AS baselines, count(*) FILTER (lost > 0) AS losts FROM base GROUP BY site_id)"""


def _h(prefix: str, number: str) -> str:
    return f"printf('{prefix}%03d', {number})"


@query(
    "workbook_habitats_post",
    f"""{SHEETS},
kept AS (
  SELECT site_id, {_h('H', 'ref')} || CASE WHEN enhanced > 0 THEN 'a' ELSE '' END AS ref, CAST(ref AS VARCHAR) AS baseline_ref,
    'Retained' AS retention, retained AS amount, base_type, base_type AS prop_type, base_condition AS prop_condition,
    CAST(NULL AS INTEGER) AS advance_years, CAST(NULL AS INTEGER) AS delay_years
  FROM base WHERE retained > 0),
lifted AS (
  SELECT b.site_id, {_h('H', 'b.ref')} || CASE WHEN retained > 0 THEN 'b' ELSE '' END, CAST(b.ref AS VARCHAR),
    'Enhanced', enhanced, b.base_type, e.prop_type, e.prop_condition, e.adv, CASE WHEN e.ref IS NOT NULL THEN 0 END
  FROM base b LEFT JOIN better e ON e.site_id = b.site_id AND e.ref = b.ref WHERE enhanced > 0),
replaced AS (
  SELECT m.site_id, {_h('H', 'g.ref')}, CAST(g.ref AS VARCHAR), 'Created', m.area_m2, g.base_type, m.prop_type,
    m.prop_condition, 0, m.delay
  FROM made m JOIN gone g ON g.site_id = m.site_id AND g.created_no = m.created_no),
fresh AS (
  SELECT m.site_id, {_h('H', '(coalesce(baselines, 0) + m.created_no - coalesce(losts, 0))')}, CAST(NULL AS VARCHAR), 'Created',
    m.area_m2, m.prop_type, m.prop_type, m.prop_condition, 0, m.delay
  FROM made m LEFT JOIN counts c ON c.site_id = m.site_id
  WHERE m.created_no > coalesce(losts, 0))
SELECT site_id, ref, baseline_ref, retention, {q.rounded('amount', 3)} AS amount, base_type, prop_type, prop_condition,
  advance_years, delay_years FROM (
  SELECT * FROM kept UNION ALL SELECT * FROM lifted UNION ALL SELECT * FROM replaced UNION ALL SELECT * FROM fresh)""",
)
def habitats_post(spark, folder):
    base, made, better = sheets(spark, folder)
    rows = op.post_rows(base, made, better, "habitats", rank)
    return rows.select(
        "site_id", "ref", "baseline_ref", "retention", rounded("amount", 3).alias("amount"),
        "base_type", "prop_type", "prop_condition", "advance_years", "delay_years",
    )


@query(
    "workbook_hedgerows_post",
    f"""{SHEETS},
kept AS (
  SELECT site_id, {_h('HG', 'ref')} || CASE WHEN enhanced > 0 THEN 'a' ELSE '' END AS ref, CAST(ref AS VARCHAR) AS baseline_ref,
    'Retained' AS retention, CASE WHEN fate = 3 THEN area_m2 ELSE retained END AS amount, base_type, base_type AS prop_type
  FROM base WHERE retained > 0 OR fate = 3),
lifted AS (
  SELECT b.site_id, {_h('HG', 'b.ref')} || CASE WHEN retained > 0 THEN 'b' ELSE '' END, CAST(b.ref AS VARCHAR),
    'Enhanced', enhanced, b.base_type, e.prop_type
  FROM base b LEFT JOIN better e ON e.site_id = b.site_id AND e.ref = b.ref WHERE enhanced > 0),
fresh AS (
  SELECT m.site_id, {_h('HG', '(coalesce(baselines, 0) + m.created_no)')}, CAST(NULL AS VARCHAR), 'Created', m.area_m2,
    m.prop_type, m.prop_type
  FROM made m LEFT JOIN counts c ON c.site_id = m.site_id)
SELECT site_id, ref, baseline_ref, retention, {q.rounded('amount', 3)} AS amount, base_type, prop_type FROM (
  SELECT * FROM kept UNION ALL SELECT * FROM lifted UNION ALL SELECT * FROM fresh)""",
)
def hedgerows_post(spark, folder):
    base, made, better = sheets(spark, folder, "hedgerows")
    rows = op.post_rows(base, made, better, "hedgerows", rank)
    return rows.select(
        "site_id", "ref", "baseline_ref", "retention", rounded("amount", 3).alias("amount"), "base_type", "prop_type"
    )


@query(
    "workbook_trees_post",
    f"""{SHEETS},
kept AS (
  SELECT site_id, {_h('T', 'ref')} || CASE WHEN enhanced > 0 THEN 'a' ELSE '' END AS ref, CAST(ref AS VARCHAR) AS baseline_ref,
    'Retained' AS retention FROM base WHERE retained > 0),
lifted AS (
  SELECT site_id, {_h('T', 'ref')} || CASE WHEN retained > 0 THEN 'b' ELSE '' END, CAST(ref AS VARCHAR), 'Enhanced'
  FROM base WHERE enhanced > 0),
fresh AS (
  SELECT m.site_id, {_h('T', '(coalesce(baselines, 0) + m.created_no)')}, CAST(NULL AS VARCHAR), 'Created'
  FROM made m LEFT JOIN counts c ON c.site_id = m.site_id)
SELECT * FROM kept UNION ALL SELECT * FROM lifted UNION ALL SELECT * FROM fresh""",
)
def trees_post(spark, folder):
    base, made, _ = sheets(spark, folder, "trees")
    rows = op.post_rows(base, made, None, "trees", rank)
    return rows.select("site_id", "ref", "baseline_ref", "retention")


@query(
    "workbook_baseline_rows",
    f"""{SHEETS}
SELECT site_id, {_h('H', 'ref')} AS ref, CAST(ref AS VARCHAR) AS baseline_ref, area_m2 AS area, base_broad AS broad,
  base_type AS type, dist AS distinctiveness, base_condition AS condition, 'Low' AS strategic_significance FROM base""",
)
def baseline_rows(spark, folder):
    base, _, _ = sheets(spark, folder)
    return op.baseline_rows(base, "habitats")


def metric_table(spark):
    """Valid (broad, type, condition) rows of the synthetic lookups."""
    names = t.synthetic_lookups(spark).condition
    return names.select(
        F.split_part("name", F.lit(" - "), F.lit(1)).alias("broad"),
        F.split_part("name", F.lit(" - "), F.lit(2)).alias("type"),
        "condition",
    )


STRICT = f"""{SHEETS}, {q.AREA_LOOKUPS},
judged AS (SELECT b.*, v.name IS NOT NULL AS valid FROM base b
  LEFT JOIN valid v ON v.name = b.base_broad || ' - ' || b.base_type AND v.condition = b.base_condition)"""


@query(
    "workbook_strict_kept",
    f"{STRICT} SELECT site_id, {_h('H', 'ref')} AS ref, base_type AS type, base_condition AS condition FROM judged WHERE valid",
)
def strict_kept(spark, folder):
    kept, _ = op.strict_habitats(sheets(spark, folder)[0], metric_table(spark))
    return op.baseline_rows(kept, "habitats").select("site_id", "ref", "type", "condition")


@query(
    "workbook_strict_skip_reasons",
    f"""{STRICT} SELECT site_id, ref, 'Skipped habitat ref ' || ref || ': ''' || base_broad || ' - ' || base_type
  || ''' in condition ''' || base_condition || ''' is not in the metric' AS reason FROM judged WHERE NOT valid""",
)
def strict_skips(spark, folder):
    return op.strict_habitats(sheets(spark, folder)[0], metric_table(spark))[1]


@query(
    "workbook_sheet_counts",
    f"""{SHEETS}, sites AS (SELECT DISTINCT site_id FROM src WHERE true)
SELECT s.site_id, coalesce(b.k, 0) AS habitats_baseline, coalesce(m.k, 0) AS habitats_created,
  coalesce(e.k, 0) AS habitats_enhancements
FROM sites s
LEFT JOIN (SELECT site_id, count(*) AS k FROM base GROUP BY 1) b ON b.site_id = s.site_id
LEFT JOIN (SELECT site_id, count(*) AS k FROM made GROUP BY 1) m ON m.site_id = s.site_id
LEFT JOIN (SELECT site_id, count(*) AS k FROM better GROUP BY 1) e ON e.site_id = s.site_id""",
)
def sheet_counts(spark, folder):
    base, made, better = sheets(spark, folder)
    return op.sheet_counts(
        {("habitats", "baseline"): base, ("habitats", "created"): made, ("habitats", "enhancements"): better}
    )


@query(
    "workbook_stage_selection",
    f"""{SHEETS}
SELECT 'baseline' AS stage, count(*) AS rows, count(DISTINCT site_id) AS sites FROM base
UNION ALL
SELECT 'post-intervention', (SELECT count(*) FROM base WHERE retained > 0) + (SELECT count(*) FROM base WHERE enhanced > 0)
  + (SELECT count(*) FROM made),
  (SELECT count(DISTINCT site_id) FROM (SELECT site_id FROM base WHERE retained > 0 OR enhanced > 0
    UNION ALL SELECT site_id FROM made))""",
)
def stage_selection(spark, folder):
    base, made, better = sheets(spark, folder)
    both = op.stage_rows(op.baseline_rows(base, "habitats"), op.post_rows(base, made, better, "habitats", rank))
    return both.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("site_id").alias("sites"))
