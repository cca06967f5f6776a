"""Pricing and net-gain queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewise.functions import scalars as sc
from hedgewise.operators import lookups as lk
from hedgewise.operators.netgain import gain_mismatches, net_gain
from hedgewise.operators.pricing import price, with_tree_size
from hedgewise.plans import scratch_path
from workload import sql as q
from workload import tables as t
from workload.registry import query


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison by the same arithmetic as in the SQL."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * 10.0**digits + 0.5).cast("double") / 10.0**digits


def priced_parcels(spark, folder) -> DataFrame:
    return price(t.pricing_input(t.parcels(spark, folder)), t.synthetic_lookups(spark))


PRICE_COLUMNS_SQL = f"""
  site_id, l_linenumber, l_partkey, l_suppkey, retention,
  {q.rounded('base_units')} AS base_units, {q.rounded('post_units')} AS post_units,
  post_time AS time_multiplier, post_difficulty AS difficulty_multiplier,
  post_band AS difficulty_band, standard_years, base_reject, post_reject"""


def price_columns(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        *extra, "site_id", "l_linenumber", "l_partkey", "l_suppkey", "retention",
        rounded("base_price.units").alias("base_units"),
        rounded("post_price.units").alias("post_units"),
        F.col("post_price.time").alias("time_multiplier"),
        F.col("post_price.difficulty").alias("difficulty_multiplier"),
        F.col("post_price.band").alias("difficulty_band"),
        F.col("post_price.standard_years").alias("standard_years"),
        F.col("base_price.reject").alias("base_reject"),
        F.col("post_price.reject").alias("post_reject"),
    )


@query("price_area_parcels", f"{q.AREA_PRICED} SELECT {PRICE_COLUMNS_SQL} FROM priced")
def price_area(spark, folder):
    return price_columns(priced_parcels(spark, folder))


def _linear(kind):
    return f"""WITH {q.linear_lookups(kind)}, {q.linear_rows(kind)}, {q.priced(kind, 'Created')}
SELECT {PRICE_COLUMNS_SQL} FROM priced"""


@query("price_hedgerows", _linear("hedgerow"))
def price_hedgerows(spark, folder):
    rows = t.linear_features(spark, folder, lk.HEDGEROW)
    return price_columns(price(rows, t.synthetic_lookups(spark, lk.HEDGEROW), lk.HEDGEROW))


@query("price_watercourses", _linear("watercourse"))
def price_watercourses(spark, folder):
    rows = t.linear_features(spark, folder, lk.WATERCOURSE)
    return price_columns(price(rows, t.synthetic_lookups(spark, lk.WATERCOURSE), lk.WATERCOURSE))


TREE_ROWS = """
rows_in AS (
  SELECT p.* EXCLUDE (retention), CASE WHEN retention = 'Lost' THEN 'Created' ELSE retention END AS retention,
    'T' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS tree_ref,
    a.area_m2 / 10000.0 AS size, base_broad || ' - ' || base_type AS base_name,
    prop_broad || ' - ' || prop_type AS prop_name
  FROM parcels p
  LEFT JOIN (VALUES (0, 41.0), (1, 163.0), (2, 366.0)) AS a(k, area_m2) ON a.k = p.l_partkey % 4)"""


@query(
    "price_trees",
    f"""WITH {q.PARCELS}, {q.AREA_LOOKUPS}, {TREE_ROWS}, {q.priced('area', 'Created')}
SELECT tree_ref, CAST(size AS DOUBLE) AS size, {PRICE_COLUMNS_SQL} FROM priced""",
)
def price_trees(spark, folder):
    lookups = t.synthetic_lookups(spark)
    rows = price(with_tree_size(t.trees(spark, folder), lookups), lookups, lk.AREA, ("Created",))
    return price_columns(rows, "tree_ref", "size")


GAIN_COLUMNS_SQL = f"""{q.rounded('baseline_units')} AS baseline_units, {q.rounded('post_units')} AS post_units,
  priced, skipped, {q.rounded('net_unit_change')} AS net_unit_change,
  {q.rounded('net_gain_pct', 4)} AS net_gain_pct, coalesce(net_gain_pct >= 10, false) AS met"""


def gain_columns(gains: DataFrame, *keys: str) -> DataFrame:
    return gains.select(
        *keys,
        rounded("baseline_units").alias("baseline_units"),
        rounded("post_units").alias("post_units"),
        "priced", "skipped",
        rounded("net_unit_change").alias("net_unit_change"),
        rounded("net_gain_pct", 4).alias("net_gain_pct"),
        "met",
    )


@query("net_gain_by_site", f"{q.AREA_PRICED}, {q.gain()} SELECT site_id, {GAIN_COLUMNS_SQL} FROM gains")
def net_gain_by_site(spark, folder):
    return gain_columns(net_gain(priced_parcels(spark, folder)), "site_id")


@query(
    "net_gain_labels",
    f"""{q.AREA_PRICED}, {q.gain()}, expected AS (
  SELECT *, CASE WHEN site_id % 7 = 0 THEN NULL WHEN site_id % 2 = 0 THEN 'met' ELSE 'unmet' END AS expected
  FROM gains)
SELECT site_id, CASE WHEN expected IS NULL THEN '—' ELSE expected || ' (' ||
    CASE WHEN net_gain_pct IS NULL THEN 'n/a'
         ELSE CAST(CAST(round(net_gain_pct, 1) AS DECIMAL(18,1)) AS VARCHAR) || '%' END || ')' END AS gain_cell,
  CASE WHEN net_gain_pct IS NULL THEN 'n/a'
       ELSE CAST(CAST(round(net_gain_pct, 1) AS DECIMAL(18,1)) AS VARCHAR) || '%' END AS pct_label
FROM expected""",
)
def net_gain_labels(spark, folder):
    gains = _expected(net_gain(priced_parcels(spark, folder)))
    pct = F.when(F.abs("net_gain_pct") < 0.05, 0.0).otherwise(F.round("net_gain_pct", 1))
    return gains.select(
        "site_id",
        sc.gain_cell(F.col("expected"), pct).alias("gain_cell"),
        sc.percentage_label(pct).alias("pct_label"),
    )


def _expected(gains: DataFrame) -> DataFrame:
    expected = F.when(F.col("site_id") % 7 == 0, None).when(F.col("site_id") % 2 == 0, "met").otherwise("unmet")
    return gains.withColumn("expected", expected)


@query(
    "net_gain_expectation_failures",
    f"""{q.AREA_PRICED}, {q.gain()}, expected AS (
  SELECT *, coalesce(net_gain_pct >= 10, false) AS met,
    CASE WHEN site_id % 7 = 0 THEN NULL WHEN site_id % 2 = 0 THEN 'met' ELSE 'unmet' END AS expected
  FROM gains)
SELECT site_id, expected, CASE WHEN met THEN 'met' ELSE 'unmet' END AS found FROM expected
WHERE expected IS NOT NULL AND expected <> CASE WHEN met THEN 'met' ELSE 'unmet' END""",
)
def expectation_failures(spark, folder):
    gains = _expected(net_gain(priced_parcels(spark, folder)))
    return gain_mismatches(gains).select("site_id", "expected", "found")


@query(
    "reject_reasons",
    f"""{q.AREA_PRICED}
SELECT retention, regexp_replace(coalesce(post_reject, base_reject), '\\d+', '#', 'g') AS reason, count(*) AS parcels
FROM priced WHERE post_reject IS NOT NULL OR base_reject IS NOT NULL GROUP BY 1, 2""",
)
def reject_reasons(spark, folder):
    reason = F.coalesce("post_price.reject", "base_price.reject")
    return (
        priced_parcels(spark, folder)
        .where(reason.isNotNull())
        .groupBy("retention", F.regexp_replace(reason, r"\d+", "#").alias("reason"))
        .agg(F.count(F.lit(1)).alias("parcels"))
    )


@query(
    "incomplete_features",
    f"""{q.AREA_PRICED}
SELECT retention, count(*) FILTER (base_d IS NULL OR base_c IS NULL
    OR (retention <> 'Retained' AND (prop_d IS NULL OR prop_c IS NULL))) AS incomplete, count(*) AS parcels
FROM priced GROUP BY retention""",
)
def incomplete_features(spark, folder):
    return (
        priced_parcels(spark, folder)
        .groupBy("retention")
        .agg(F.count_if("incomplete").alias("incomplete"), F.count(F.lit(1)).alias("parcels"))
    )


@query(
    "lookup_coverage",
    f"""WITH {q.PARCELS}, {q.AREA_LOOKUPS}
SELECT coalesce(band, 'unknown') AS band, cd AS create_difficulty, ed AS enhance_difficulty,
  count(*) AS parcels, {q.rounded('sum(area_m2) / 10000.0', 4)} AS hectares
FROM parcels LEFT JOIN hab ON hab.name = base_broad || ' - ' || base_type GROUP BY 1, 2, 3""",
)
def lookup_coverage(spark, folder):
    stored = scratch_path(spark, "lookups")
    lk.write_lookups(t.synthetic_lookups(spark), stored)
    attributes = lk.target_attributes(lk.read_lookups(spark, stored), lk.AREA)
    joined = lk.keyed_join(
        t.pricing_input(t.parcels(spark, folder)).drop("prop_name"),
        attributes.withColumnRenamed("prop_name", "base_name"),
        ["base_name"],
    )
    return joined.groupBy(
        F.coalesce("prop_band", F.lit("unknown")).alias("band"),
        "create_difficulty",
        "enhance_difficulty",
    ).agg(
        F.count(F.lit(1)).alias("parcels"),
        rounded(F.sum("area_m2") / 10000.0, 4).alias("hectares"),
    )
