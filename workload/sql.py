"""SQL over the given tables that states the derived layers and lookups independently."""

from __future__ import annotations


def picked(values: list, index: str) -> str:
    items = ", ".join(repr(v) for v in values)
    return f"([{items}])[CAST({index} AS INTEGER) + 1]"


CONDITIONS = "['Good','Fairly Good','Moderate','Fairly Poor','Poor']"

YEAR_TEXTS = """
  CASE WHEN l_quantity = 50 THEN '4' WHEN l_quantity = 49 THEN '31' WHEN l_quantity = 48 THEN '5 yrs'
       WHEN l_linestatus = 'O' AND l_quantity <= 20 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
       ELSE '' END AS advance_raw,
  CASE WHEN l_quantity = 50 THEN '3'
       WHEN l_linestatus = 'F' AND l_quantity <= 20 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
  END AS delay_raw"""

YEARS = """
  coalesce(try_cast(nullif(regexp_extract(advance_raw, '^\\s*([+-]?\\d+)', 1), '') AS INTEGER), 0) AS adv,
  coalesce(try_cast(nullif(regexp_extract(delay_raw, '^\\s*([+-]?\\d+)', 1), '') AS INTEGER), 0) AS del"""

PARCELS = f"""
parcels AS (
  SELECT l_orderkey AS site_id, l_linenumber, l_partkey, l_suppkey, l_quantity,
    'H' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS parcel_ref,
    l_extendedprice AS area_m2,
    'Broad ' || ((l_partkey % 9) % 3) AS base_broad, 'Type ' || (l_partkey % 9) AS base_type,
    {CONDITIONS}[CAST(l_suppkey % 5 AS INTEGER) + 1] AS base_condition,
    'Broad ' || (((l_partkey + l_suppkey) % 9) % 3) AS prop_broad,
    'Type ' || ((l_partkey + l_suppkey) % 9) AS prop_type,
    {CONDITIONS}[CAST((l_suppkey + l_linenumber) % 5 AS INTEGER) + 1] AS prop_condition,
    CASE l_returnflag WHEN 'R' THEN 'Retained' WHEN 'A' THEN 'Enhanced' ELSE 'Lost' END AS retention,
    {YEAR_TEXTS},
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n
  FROM lineitem)"""

# Area lookups: habitat h in 0..7, condition c in 0..4.
AREA_LOOKUPS = f"""
hab AS (
  SELECT 'Broad ' || (h % 3) || ' - Type ' || h AS name,
    ([2.0,6.0,4.0,6.0,6.0,4.0,2.0,0.0])[h + 1]::DOUBLE AS d,
    (['Low','High','Medium','High','High','Medium','Low','V.Low'])[h + 1] AS band,
    (['Low','High','Medium','High','Low','Very High','Low','Low'])[h + 1] AS cd,
    (['Low','Medium','Medium','High','Medium','High','Low','Low'])[h + 1] AS ed, h
  FROM (SELECT CAST(range AS INTEGER) AS h FROM range(8))),
cond AS (
  SELECT {CONDITIONS}[c + 1] AS condition, ([3.0,2.5,2.0,1.5,1.0])[c + 1]::DOUBLE AS c_score, c
  FROM (SELECT CAST(range AS INTEGER) AS c FROM range(5))),
valid AS (SELECT name, condition, c_score, h, c FROM hab CROSS JOIN cond WHERE NOT (h = 5 AND c = 1)),
yc AS (SELECT name, condition, CASE WHEN NOT (h = 6 AND c = 4) THEN (h * 7 + c * 5) % 34 END AS years
       FROM hab CROSS JOIN cond),
ye AS (SELECT h0.name AS n0, c0.condition AS q0, h1.name AS n1, c1.condition AS q1,
         CASE WHEN NOT (h1.h = 6 AND c1.c = 4)
              THEN (h0.h + c0.c * 3 + h1.h * 7 + c1.c * 5) % 34 END AS years
       FROM hab h0 CROSS JOIN cond c0 CROSS JOIN hab h1 CROSS JOIN cond c1)"""


def linear_lookups(kind: str) -> str:
    if kind == "hedgerow":
        prefix, count = "Hedge ", 6
        scores, bands = "[2.0,6.0,4.0,8.0,1.0,4.0]", "['Low','High','Medium','V.High','V.Low','Medium']"
        create = enhance = "['Low','Low','Low','Low','Low','Low']"
    else:
        prefix, count = "Water ", 4
        scores, bands = "[2.0,4.0,6.0,8.0]", "['Low','Medium','High','V.High']"
        create, enhance = "['Low','Medium','High','Very High']", "['Low','Low','Medium','High']"
    return f"""
hab AS (
  SELECT '{prefix}' || h AS name, ({scores})[h + 1]::DOUBLE AS d, ({bands})[h + 1] AS band,
    ({create})[h + 1] AS cd, ({enhance})[h + 1] AS ed, h
  FROM (SELECT CAST(range AS INTEGER) AS h FROM range({count}))),
cond AS (
  SELECT {CONDITIONS}[c + 1] AS condition, ([3.0,2.5,2.0,1.5,1.0])[c + 1]::DOUBLE AS c_score, c
  FROM (SELECT CAST(range AS INTEGER) AS c FROM range(5))),
valid AS (SELECT name, condition, c_score, h, c FROM hab CROSS JOIN cond WHERE NOT (h = 5 AND c = 1)),
yc AS (SELECT name, condition, (h * 7 + c * 5) % 34 AS years FROM hab CROSS JOIN cond),
ye AS (SELECT h0.name AS n0, c0.condition AS q0, h1.name AS n1, c1.condition AS q1,
         (h0.h + c0.c * 3 + h1.h * 7 + c1.c * 5) % 34 AS years
       FROM hab h0 CROSS JOIN cond c0 CROSS JOIN hab h1 CROSS JOIN cond c1)"""


def linear_rows(kind: str) -> str:
    prefix, letter, count = ("Hedge ", "HG", 7) if kind == "hedgerow" else ("Water ", "R", 5)
    return f"""
rows_in AS (
  SELECT l_orderkey AS site_id, l_linenumber, l_partkey, l_suppkey,
    '{letter}' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS parcel_ref,
    l_extendedprice / 1000 AS size,
    '{prefix}' || (l_partkey % {count}) AS base_name,
    {CONDITIONS}[CAST(l_suppkey % 5 AS INTEGER) + 1] AS base_condition,
    '{prefix}' || ((l_partkey + l_suppkey) % {count}) AS prop_name,
    {CONDITIONS}[CAST((l_suppkey + l_linenumber) % 5 AS INTEGER) + 1] AS prop_condition,
    CASE WHEN l_linenumber = 7 THEN 'Lost' WHEN l_returnflag = 'R' THEN 'Retained'
         WHEN l_returnflag = 'A' THEN 'Enhanced' ELSE 'Created' END AS retention,
    (['None','Minor','Major',NULL])[CAST(l_partkey % 4 AS INTEGER) + 1] AS prop_encroachment,
    (['None/None','Minor/None','Major/Major',NULL])[CAST(l_suppkey % 4 AS INTEGER) + 1] AS prop_riparian,
    {YEAR_TEXTS}
  FROM lineitem)"""


AREA_ROWS = """
rows_in AS (
  SELECT *, area_m2 / 10000.0 AS size, base_broad || ' - ' || base_type AS base_name,
    prop_broad || ' - ' || prop_type AS prop_name, 1.0 AS enc, 1.0 AS rip
  FROM parcels)"""


def priced(kind: str, created_label: str) -> str:
    """CTEs from ``rows_in`` to ``priced`` with both sides' units, factors and reject reasons."""
    enc = ""
    pressed, missing, poor = "", "", ""
    if kind == "watercourse":
        enc = """
  LEFT JOIN (VALUES ('None', 1.0), ('Minor', 0.8), ('Major', 0.5)) AS e(en, em) ON e.en = r.prop_encroachment
  LEFT JOIN (VALUES ('None/None', 1.0), ('Minor/None', 0.9), ('Major/Major', 0.6)) AS p(rn, rm)
    ON p.rn = r.prop_riparian"""
        pressed = " * (coalesce(em, 1.0)::DOUBLE * coalesce(rm, 1.0)::DOUBLE)"
        missing = "WHEN em IS NULL OR rm IS NULL THEN 'Encroachment missing for habitat: ' || prop_name"
    area = kind == "area"
    if area:
        poor = """WHEN adv <= 0 AND poor IS NULL
         THEN 'Time to target ''Not Possible'' for habitat: ' || prop_name || ', endCondition: Poor'"""
    covered_c = "WHEN adv > 0 AND adv >= CASE WHEN cy + del - adv < 0 THEN 0 ELSE cy + del - adv END THEN 'Low'" if area else ""
    covered_e = "WHEN adv > 0 AND adv >= CASE WHEN ey + del - adv < 0 THEN 0 ELSE ey + del - adv END THEN 'Low'" if area else ""
    time = "CASE WHEN {0} > 30 THEN 0.3197967361 ELSE round(pow(0.965, {0}), 10) END"
    mult = "CASE {0} WHEN 'Low' THEN 1.0 WHEN 'Medium' THEN 0.67 WHEN 'High' THEN 0.33 WHEN 'Very High' THEN 0.1 END::DOUBLE"
    shift = """WHEN adv > 0 AND del > 0 THEN 'Advance (' || adv || ') and delay (' || del || ') years cannot both be used on the same habitat. Use one or the other, or split the habitat across two parcels.'
      WHEN adv > 30 OR del > 30 THEN 'Advance (' || adv || ') or delay (' || del || ') years exceed the limit of 30'"""
    sized = "WHEN size IS NULL THEN 'Size missing'"
    unknown = "WHEN {0}_d IS NULL THEN 'Habitat ''' || {0}_name || ''' is not a valid habitat'"
    invalid = "WHEN {0}_c IS NULL THEN 'Condition ''' || {0}_condition || ''' is not a valid condition for habitat: ' || {0}_name"
    return f"""
timed AS (SELECT *, {YEARS} FROM rows_in),
looked AS (
  SELECT r.*, hb.d AS base_d, hb.band AS base_band, vb.c_score AS base_c,
    hp.d AS prop_d, hp.band AS prop_band, hp.cd, hp.ed, vp.c_score AS prop_c,
    yc.years AS cy, yp.years AS poor, ye.years AS ey{", em, rm" if enc else ""}
  FROM timed r
  LEFT JOIN hab hb ON hb.name = r.base_name
  LEFT JOIN valid vb ON vb.name = r.base_name AND vb.condition = r.base_condition
  LEFT JOIN hab hp ON hp.name = r.prop_name
  LEFT JOIN valid vp ON vp.name = r.prop_name AND vp.condition = r.prop_condition
  LEFT JOIN yc ON yc.name = r.prop_name AND yc.condition = r.prop_condition
  LEFT JOIN yc yp ON yp.name = r.prop_name AND yp.condition = 'Poor'
  LEFT JOIN ye ON ye.n0 = r.base_name AND ye.q0 = r.base_condition
              AND ye.n1 = r.prop_name AND ye.q1 = r.prop_condition{enc}),
banded AS (
  SELECT *,
    CASE {covered_c} WHEN adv > 0 AND adv >= CASE WHEN poor + del - adv < 0 THEN 0 ELSE poor + del - adv END THEN ed ELSE cd END AS c_band,
    CASE {covered_e} WHEN true THEN ed END AS e_band,
    CASE WHEN cy + del - adv < 0 THEN 0 ELSE cy + del - adv END AS c_wait, CASE WHEN ey + del - adv < 0 THEN 0 ELSE ey + del - adv END AS e_wait
  FROM looked),
factored AS (
  SELECT *, {time.format('c_wait')} AS c_t, {time.format('e_wait')} AS e_t,
    {mult.format('c_band')} AS c_f, {mult.format('e_band')} AS e_f,
    CASE {unknown.format('base')} {invalid.format('base')} {sized} END AS base_reject,
    CASE {unknown.format('prop')} {invalid.format('prop')} {shift}
      WHEN cy IS NULL THEN 'Time to target ''Not Possible'' for habitat: ' || prop_name || ', endCondition: ' || prop_condition
      {poor} {missing} {sized} END AS created_reject,
    CASE {unknown.format('base')} {unknown.format('prop')} {invalid.format('base')} {invalid.format('prop')} {shift}
      WHEN ey IS NULL THEN 'Time to target ''Not Possible'' for habitat: ' || prop_name || ', endCondition: ' || prop_condition
      {sized} END AS enhanced_reject
  FROM banded),
priced_raw AS (
  SELECT *,
    CASE retention WHEN 'Retained' THEN base_reject WHEN 'Enhanced' THEN enhanced_reject
      WHEN '{created_label}' THEN created_reject
      ELSE 'Retention category ''' || retention || ''' is not priced' END AS post_reject,
    CASE WHEN base_reject IS NULL THEN (size * base_d * base_c){pressed} END AS base_raw,
    CASE retention
      WHEN 'Retained' THEN (size * base_d * base_c){pressed}
      WHEN 'Enhanced' THEN (size * base_d * base_c
        + (size * prop_d * prop_c - size * base_d * base_c) * e_t * e_f){pressed}
      WHEN '{created_label}' THEN (size * prop_d * prop_c * c_t * c_f){pressed} END AS post_raw
  FROM factored),
priced AS (
  SELECT *,
    CAST(printf('%.14e', base_raw) AS DOUBLE) AS base_units,
    CASE WHEN post_reject IS NULL THEN CAST(printf('%.14e', post_raw) AS DOUBLE) END AS post_units,
    CASE WHEN post_reject IS NULL THEN CASE retention WHEN 'Enhanced' THEN e_t
      WHEN '{created_label}' THEN c_t END END AS post_time,
    CASE WHEN post_reject IS NULL THEN CASE retention WHEN 'Enhanced' THEN e_f
      WHEN '{created_label}' THEN c_f END END AS post_difficulty,
    CASE WHEN post_reject IS NULL THEN CASE retention WHEN 'Enhanced' THEN e_band
      WHEN '{created_label}' THEN c_band END END AS post_band,
    CASE WHEN post_reject IS NULL THEN CASE retention WHEN 'Enhanced' THEN ey
      WHEN '{created_label}' THEN cy END END AS standard_years
  FROM priced_raw)"""


def rounded(expression: str, digits: int = 6) -> str:
    return f"CAST(floor(({expression}) * 1e{digits} + 0.5) AS DOUBLE) / 1e{digits}"


AREA_PRICED = f"WITH {PARCELS}, {AREA_LOOKUPS}, {AREA_ROWS}, {priced('area', 'Lost')}"


def gain(keys: str = "site_id") -> str:
    """CTE ``gains`` from ``priced``."""
    return f"""
totals AS (
  SELECT {keys},
    coalesce(sum(base_units) FILTER (base_units IS NOT NULL AND post_units IS NOT NULL), 0.0) AS baseline_units,
    coalesce(sum(post_units) FILTER (base_units IS NOT NULL AND post_units IS NOT NULL), 0.0) AS post_units,
    count(*) FILTER (base_units IS NOT NULL AND post_units IS NOT NULL) AS priced,
    count(*) FILTER (base_units IS NULL OR post_units IS NULL) AS skipped
  FROM priced GROUP BY {keys}),
gains AS (
  SELECT *, post_units - baseline_units AS net_unit_change,
    CASE WHEN baseline_units <> 0 THEN (post_units - baseline_units) / baseline_units * 100 END AS net_gain_pct
  FROM totals)"""
