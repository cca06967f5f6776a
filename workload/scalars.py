"""Scalar-function and name-matching queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hedgewise.functions import reproject as rp
from hedgewise.functions import scalars as sc
from hedgewise.operators import lookups as lk
from hedgewise.operators import projects as pj
from hedgewise.sources import tables as src
from workload import sql as q
from workload import tables as t
from workload.pricing import rounded
from workload.registry import query


@query(
    "parcel_scalars",
    f"""WITH {q.PARCELS}, y AS (SELECT *, {q.YEARS} FROM parcels)
SELECT site_id, l_linenumber, l_partkey, l_suppkey, base_broad || ' - ' || base_type AS base_name,
  {q.rounded('area_m2 / 10000.0', 9)} AS size_ha, adv AS advance, del AS delay,
  printf('HG%03d', l_partkey) AS hedge_ref,
  regexp_replace(parcel_ref || (['', 'a', 'B'])[CAST(l_partkey % 3 AS INTEGER) + 1], '[A-Za-z]$', '') AS parent_ref FROM y""",
)
def parcel_scalars(spark, folder):
    rows = t.pricing_input(t.parcels(spark, folder))
    lettered = F.concat("parcel_ref", t.pick(["", "a", "B"], F.col("l_partkey") % 3))
    return rows.select(
        "site_id", "l_linenumber", "l_partkey", "l_suppkey", "base_name", rounded("size", 9).alias("size_ha"),
        sc.years(F.col("advance_raw")).alias("advance"), sc.years(F.col("delay_raw")).alias("delay"),
        sc.layer_ref("hedgerows", F.col("l_partkey")).alias("hedge_ref"),
        sc.parent_ref(lettered).alias("parent_ref"),
    )


@query(
    "significant_figures",
    """WITH v AS (SELECT *, l_extendedprice * l_discount / 7.0 * ([1.0, 1e-13, 1e13])[CAST(l_partkey % 3 AS INTEGER) + 1] AS value FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN CAST(printf('%.14e', value) AS DOUBLE) END AS trimmed,
  abs(CAST(printf('%.14e', value) AS DOUBLE) - value) <= abs(value) * 1e-14 AS near, l_partkey % 3 <> 0 OR NULL AS far FROM v""",
)
def significant_figures(spark, folder):
    value = F.col("l_extendedprice") * F.col("l_discount") / 7.0 * t.pick([1.0, 1e-13, 1e13], F.col("l_partkey") % 3)
    rows = t.load(spark, folder, "lineitem").withColumn("value", value)
    rows = rows.withColumn("trimmed", sc.significant(F.col("value")))
    # far from 1, halves may fall the other way than in the exact binary value, so there only the distance is compared,
    # and that a second rounding changes nothing
    far = F.col("l_partkey") % 3 != 0
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(~far, F.col("trimmed")).alias("trimmed"),
        (F.abs(F.col("trimmed") - F.col("value")) <= F.abs("value") * 1e-14).alias("near"),
        F.when(far, sc.significant(F.col("trimmed")) == F.col("trimmed")).alias("far"),
    )


@query(
    "source_urls",
    """WITH u AS (SELECT page_id, url, CASE page_id % 3
    WHEN 0 THEN 'https://github.com/owner' || page_id || '/repo/blob/main/metrics/' || page_id || '.xlsx?raw=1'
    WHEN 1 THEN url || '.XLSM#sheet' ELSE url END AS source FROM pages),
w AS (SELECT *, regexp_replace(regexp_replace(source, '[?#](.|\\n)*$', ''), '/+$', '') AS cut FROM u)
SELECT page_id, regexp_replace(source, '^https://github\\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)$',
    'https://media.githubusercontent.com/media/\\1/\\2/\\3/\\4') AS media_url,
  coalesce(nullif(regexp_replace(string_split(cut, '/')[-1], '\\.(xlsx|xlsm|xls)$', '', 'i'), ''), 'bng-from-workbook') AS base_name,
  substr(sha256(source), 1, 16) AS cache_key FROM w""",
)
def source_urls(spark, folder):
    key = F.col("page_id")
    hosted = F.concat(
        F.lit("https://github.com/owner"), key.cast("string"), F.lit("/repo/blob/main/metrics/"),
        key.cast("string"), F.lit(".xlsx?raw=1"),
    )
    source = F.when(key % 3 == 0, hosted).when(key % 3 == 1, F.concat("url", F.lit(".XLSM#sheet"))).otherwise(F.col("url"))
    rows = t.load(spark, folder, "pages").select("page_id", source.alias("source"))
    return rows.select(
        "page_id", sc.media_url(F.col("source")).alias("media_url"),
        sc.source_base_name(F.col("source")).alias("base_name"), sc.cache_key(F.col("source")).alias("cache_key"),
    )


@query(
    "event_stamps",
    """SELECT event_id, strftime(ts, '%Y%m%d-%H%M-%S') AS stamp,
  event_type || '-baseline-' || strftime(ts, '%Y%m%d-%H%M-%S') || '.gpkg' AS file_name FROM events""",
)
def event_stamps(spark, folder):
    stamp = sc.timestamp_suffix(F.col("ts"))
    return t.load(spark, folder, "events").select(
        "event_id", stamp.alias("stamp"), sc.stage_file_name(F.col("event_type"), "baseline", stamp).alias("file_name")
    )


@query(
    "grid_envelope_warnings",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  (l_extendedprice * 10 BETWEEN 0 AND 700000) AND (l_extendedprice * 15 - 1000 BETWEEN 0 AND 1300000) AS inside FROM lineitem""",
)
def grid_envelope(spark, folder):
    price = F.col("l_extendedprice")
    return t.load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        sc.in_grid_envelope(price * 10, price * 15 - 1000).alias("inside"),
    )


@query(
    "annotated_list_entries",
    r"""WITH lines AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS value FROM documents),
trimmed AS (SELECT doc_id, regexp_replace(value,
  '^[\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x{0B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g') AS entry FROM lines)
SELECT doc_id, entry FROM trimmed WHERE entry <> '' AND NOT starts_with(entry, '#')""",
)
def list_entries(spark, folder):
    lines = t.load(spark, folder, "documents").select("doc_id", F.explode(src.split_lines(F.col("text"))).alias("value"))
    return src.list_entries(lines).select("doc_id", "entry")


def catalogue(spark, folder):
    """Distinct ``<type> - <name>`` entries of ``part``, numbered by first key."""
    full = F.concat("p_type", F.lit(" - "), "p_name")
    return t.load(spark, folder, "part").groupBy(full.alias("full_name")).agg(F.min("p_partkey").alias("cat_no"))


CATALOGUE = "cat AS (SELECT p_type || ' - ' || p_name AS full_name, min(p_partkey) AS cat_no FROM part GROUP BY 1)"
WANTED = """wanted AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || p_type || ' - ' || p_name
  WHEN 1 THEN lower(p_type) || ' - ' || upper(p_name) WHEN 2 THEN p_name ELSE p_type || ' - unknown' END AS name FROM part)"""


def wanted(spark, folder):
    key = F.col("p_partkey")
    name = (
        F.when(key % 4 == 0, F.concat(F.lit(" "), "p_type", F.lit(" - "), "p_name"))
        .when(key % 4 == 1, F.concat(F.lower("p_type"), F.lit(" - "), F.upper("p_name")))
        .when(key % 4 == 2, F.col("p_name"))
        .otherwise(F.concat("p_type", F.lit(" - unknown")))
    )
    return t.load(spark, folder, "part").select("p_partkey", name.alias("name"))


@query(
    "match_habitat_names",
    f"""WITH {CATALOGUE}, {WANTED}, folded AS (SELECT lower(full_name) AS f, arg_min(full_name, cat_no) AS by_case FROM cat GROUP BY 1)
SELECT p_partkey, name, coalesce(c.full_name, by_case) AS full_name FROM wanted w
LEFT JOIN cat c ON c.full_name = trim(w.name) LEFT JOIN folded ON f = lower(trim(w.name))""",
)
def match_names(spark, folder):
    return lk.match_names(wanted(spark, folder), catalogue(spark, folder)).select("p_partkey", "name", "full_name")


@query(
    "suggest_habitat_names",
    f"""WITH {CATALOGUE}, {WANTED}, n AS (SELECT DISTINCT name, lower(trim(name)) AS whole,
    instr(lower(trim(name)), ' - ') AS pos FROM wanted),
p AS (SELECT *, CASE WHEN pos = 0 THEN whole ELSE substr(whole, 1, pos - 1) END AS broad,
    CASE WHEN pos > 0 THEN substr(whole, pos + 3) ELSE '' END AS kind FROM n),
hits AS (SELECT name, full_name, cat_no FROM p JOIN cat ON contains(lower(full_name), whole)
    OR starts_with(lower(full_name), broad) OR (kind <> '' AND contains(lower(full_name), kind))),
ranked AS (SELECT name, full_name, CAST(row_number() OVER (PARTITION BY name ORDER BY cat_no) AS INTEGER) AS suggestion_no FROM hits)
SELECT * FROM ranked WHERE suggestion_no <= 5""",
)
def suggest_names(spark, folder):
    return lk.suggest_names(wanted(spark, folder), catalogue(spark, folder))


@query(
    "project_geometries",
    """SELECT o_orderkey AS project_id, 'Habitats' AS layer, l_linenumber, l_partkey, l_suppkey
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 13 <> 0""",
)
def project_geometries(spark, folder):
    rows = t.load(spark, folder, "lineitem")
    ref = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    geometries = rows.select(ref.alias("geometry_ref"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # One document per line of a project, as an append-only store keeps them.
    document = F.to_json(
        F.struct(F.array(F.struct(F.lit("Habitats").alias("layer"), F.col("geometry_ref").alias("geometryRef"))).alias("layers"))
    )
    broken = F.when(F.col("l_orderkey") % 13 == 0, "{not json").otherwise(document)
    projects = geometries.select(F.col("l_orderkey").alias("project_id"), broken.alias("document"))
    return pj.project_geometries(projects, geometries.drop("l_orderkey").dropDuplicates(["geometry_ref"])).select(
        "project_id", "layer", "l_linenumber", "l_partkey", "l_suppkey"
    )


def _wgs84_sql() -> str:
    n = (rp.AIRY_A - rp.AIRY_B) / (rp.AIRY_A + rp.AIRY_B)
    e2, w2 = 1 - rp.AIRY_B**2 / rp.AIRY_A**2, 1 - rp.WGS84_B**2 / rp.WGS84_A**2
    af = rp.AIRY_A * rp.SCALE
    c = [1 + n + 1.25 * n**2 + 1.25 * n**3, 3 * n + 3 * n**2 + 21 / 8 * n**3, 15 / 8 * n**2 + 15 / 8 * n**3, 35 / 24 * n**3]

    def num(v):
        return f"({v!r}::DOUBLE)"

    arc = (
        f"{num(rp.AIRY_B * rp.SCALE)} * ({num(c[0])} * (la - {num(rp.LAT0)})"
        f" - {num(c[1])} * sin(la - {num(rp.LAT0)}) * cos(la + {num(rp.LAT0)})"
        f" + {num(c[2])} * sin(2 * (la - {num(rp.LAT0)})) * cos(2 * (la + {num(rp.LAT0)}))"
        f" - {num(c[3])} * sin(3 * (la - {num(rp.LAT0)})) * cos(3 * (la + {num(rp.LAT0)})))"
    )
    steps = [
        "s0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 700 * 1000.0 + l_quantity AS e,"
        " l_suppkey % 130 * 10000.0 + l_linenumber AS north FROM lineitem)",
        f"a0 AS (SELECT *, (north - {num(rp.N0)}) / {num(af)} + {num(rp.LAT0)} AS la FROM s0)",
    ]
    for i in range(rp.ROUNDS):
        steps.append(
            f"a{i + 1} AS (SELECT * EXCLUDE (la), la + (north - {num(rp.N0)} - {arc}) / {num(af)} AS la FROM a{i})"
        )
    rx, ry, rz = (num(v) for v in rp.TURN)
    tx, ty, tz = (num(v) for v in rp.SHIFT)
    k = num(rp.STRETCH)
    steps += [
        f"b AS (SELECT *, tan(la) AS t, 1 / cos(la) AS sec, {num(af)} / sqrt(1 - {num(e2)} * sin(la) ** 2) AS nu,"
        f" {num(af)} * {num(1 - e2)} / (1 - {num(e2)} * sin(la) ** 2) ** 1.5 AS rho, e - {num(rp.E0)} AS de FROM a{rp.ROUNDS})",
        "c AS (SELECT *, nu / rho - 1 AS eta FROM b)",
        f"""d AS (SELECT *, la - t / (2 * rho * nu) * de ** 2
  + t / (24 * rho * nu ** 3) * (5 + 3 * t ** 2 + eta - 9 * t ** 2 * eta) * de ** 4
  - t / (720 * rho * nu ** 5) * (61 + 90 * t ** 2 + 45 * t ** 4) * de ** 6 AS phi,
  {num(rp.LON0)} + sec / nu * de - sec / (6 * nu ** 3) * (nu / rho + 2 * t ** 2) * de ** 3
  + sec / (120 * nu ** 5) * (5 + 28 * t ** 2 + 24 * t ** 4) * de ** 5
  - sec / (5040 * nu ** 7) * (61 + 662 * t ** 2 + 1320 * t ** 4 + 720 * t ** 6) * de ** 7 AS lam FROM c)""",
        f"f AS (SELECT *, {num(rp.AIRY_A)} / sqrt(1 - {num(e2)} * sin(phi) ** 2) AS nn FROM d)",
        f"g AS (SELECT *, nn * cos(phi) * cos(lam) AS x, nn * cos(phi) * sin(lam) AS y, nn * {num(1 - e2)} * sin(phi) AS z FROM f)",
        f"h AS (SELECT *, {tx} + {k} * x - {rz} * y + {ry} * z AS x2, {ty} + {rz} * x + {k} * y - {rx} * z AS y2,"
        f" {tz} - {ry} * x + {rx} * y + {k} * z AS z2 FROM g)",
        f"p0 AS (SELECT *, sqrt(x2 * x2 + y2 * y2) AS p, atan2(z2, sqrt(x2 * x2 + y2 * y2) * {num(1 - w2)}) AS w FROM h)",
    ]
    for i in range(rp.ROUNDS):
        steps.append(
            f"p{i + 1} AS (SELECT * EXCLUDE (w), atan2(z2 + {num(w2)} * {num(rp.WGS84_A)} / sqrt(1 - {num(w2)} * sin(w) ** 2) * sin(w), p) AS w FROM p{i})"
        )
    return f"""WITH {', '.join(steps)}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {q.rounded(f'w * {180 / math.pi!r}', 7)} AS lat,
  {q.rounded(f'atan2(y2, x2) * {180 / math.pi!r}', 7)} AS lon FROM p{rp.ROUNDS}"""


@query("grid_to_wgs84", _wgs84_sql())
def grid_to_wgs84(spark, folder):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = t.load(spark, folder, "lineitem").select(
        *key,
        (F.col("l_partkey") % 700 * 1000.0 + F.col("l_quantity")).alias("easting"),
        (F.col("l_suppkey") % 130 * 10000.0 + F.col("l_linenumber")).alias("northing"),
    )
    return rp.to_wgs84(rows, "easting", "northing").select(
        *key, rounded("lat", 7).alias("lat"), rounded("lon", 7).alias("lon")
    )
