"""Source, sink, sample and streaming queries."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from hedgewise.operators import reporting as rep
from hedgewise.plans import scratch_path
from hedgewise.sources import gpkg
from hedgewise.sources import tables as src
from hedgewise.streaming import audit
from hedgewise.streaming import pricing as live
from workload import sql as q
from workload import tables as t
from workload.pricing import rounded
from workload.registry import query


def staged_layer(spark, folder):
    rows = t.parcels(spark, folder)
    base = rows.withColumns({"stage": F.lit("baseline"), "prop_type": F.lit(None).cast("string")})
    return base.unionByName(rows.withColumn("stage", F.lit("post-intervention")))


@query(
    "read_layer_pruned",
    f"WITH {q.PARCELS} SELECT site_id, parcel_ref, area_m2 FROM parcels WHERE site_id % 3 = 0",
)
def read_layer_pruned(spark, folder):
    path = scratch_path(spark, "layers")
    src.write_layer(staged_layer(spark, folder), path, "habitats")
    wanted = (F.col("stage") == "post-intervention") & (F.col("site_id") % 3 == 0)
    return src.read_layer(spark, path, "habitats", ["site_id", "parcel_ref", "area_m2"], wanted)


@query(
    "replace_partitions",
    """SELECT 'baseline' AS stage, count(*) AS rows, count(*) AS with_type FROM lineitem
UNION ALL SELECT 'post-intervention', count(*), count(*) FROM lineitem""",
)
def replace_partitions(spark, folder):
    """Rewrite the baseline partition only; the other stage stays as it was."""
    path = scratch_path(spark, "layers")
    rows = t.parcels(spark, folder).select("site_id", "prop_type")
    cleared = rows.withColumns({"stage": F.lit("baseline"), "prop_type": F.lit(None).cast("string")})
    both = cleared.unionByName(rows.withColumn("stage", F.lit("post-intervention")))
    src.write_layer(both, path, "habitats")
    src.write_layer(rows.withColumn("stage", F.lit("baseline")), path, "habitats")
    return src.read_layer(spark, path, "habitats").groupBy("stage").agg(
        F.count(F.lit(1)).alias("rows"), F.count("prop_type").alias("with_type")
    )


SHEET_SCHEMA = "site_id long, ref int, type string, area double"


@query(
    "read_sheets",
    """SELECT l_orderkey AS site_id, l_linenumber AS ref, 'Type ' || (l_partkey % 9) AS type, l_extendedprice AS area FROM lineitem
WHERE l_partkey % 97 <> 0""",
)
def read_sheets(spark, folder):
    return _sheet(spark, folder).where("problem IS NULL").drop("problem")


def _sheet(spark, folder):
    """A sheet exported to CSV, with a row that is no number here and there."""
    path = scratch_path(spark, "sheet")
    rows = t.load(spark, folder, "lineitem")
    broken = F.when(F.col("l_partkey") % 97 == 0, "n/a").otherwise(F.col("l_linenumber").cast("string"))
    rows.select(
        F.col("l_orderkey").alias("site_id"), broken.alias("ref"),
        F.concat(F.lit("Type "), (F.col("l_partkey") % 9).cast("string")).alias("type"),
        F.col("l_extendedprice").alias("area"),
    ).write.option("header", True).csv(path)
    return src.read_sheet(spark, path, SHEET_SCHEMA)


@query(
    "sheet_status",
    """SELECT 'Type ' || (l_partkey % 9) AS source, count(*) FILTER (l_partkey % 97 <> 0) AS read,
  count(*) FILTER (l_partkey % 97 = 0) AS failed,
  CASE WHEN count(*) FILTER (l_partkey % 97 = 0) = 0 THEN 'ok' ELSE 'failed rows' END AS status FROM lineitem GROUP BY 1""",
)
def sheet_status(spark, folder):
    return src.sheet_status(_sheet(spark, folder), F.col("type"))


@query(
    "sample_summary",
    f"""WITH s AS (SELECT event_type AS label, value AS elapsed, event_id % 17 <> 0 AS ok FROM events),
r AS (SELECT label, count(*) AS samples, count(*) FILTER (NOT ok) AS errors, avg(elapsed) AS mean_ms,
  quantile_cont(elapsed, 0.95) AS p95_ms FROM s GROUP BY ROLLUP (label))
SELECT label, samples, errors, {q.rounded('mean_ms', 4)} AS mean_ms, {q.rounded('p95_ms', 4)} AS p95_ms,
  CASE WHEN errors = 0 THEN 'PASS' ELSE 'FAIL (' || errors || '/' || samples || ')' END AS verdict,
  'avg ' || CAST(floor(mean_ms + 0.5) AS BIGINT) || ' ms · p95 ' || CAST(floor(p95_ms + 0.5) AS BIGINT) || ' ms' AS latency FROM r""",
)
def sample_summary(spark, folder):
    path = scratch_path(spark, "samples")
    t.load(spark, folder, "events").select(
        F.col("event_type").alias("label"), F.col("value").alias("elapsed_ms"),
        (F.col("event_id") % 17 != 0).alias("success"),
    ).write.option("header", True).csv(path)
    found = rep.sample_summary(src.read_samples(spark, path))
    return found.withColumns({"mean_ms": rounded("mean_ms", 4), "p95_ms": rounded("p95_ms", 4)})


# -- GeoPackage files ------------------------------------------------------------------


def _site_file(key: int, name: str, size: int) -> bytes:
    """A small GeoPackage with one boundary and ``size % 4`` parcels, as SQLite bytes."""
    if key % 23 == 0:
        return b"this is not a database"
    db = sqlite3.connect(":memory:")
    if key % 19 != 0:
        db.execute(f"PRAGMA application_id = {int.from_bytes(gpkg.GPKG_STAMP, 'big')}")
    db.executescript(
        """
        CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT, srs_id INTEGER);
        CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER);
        CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER);
        CREATE TABLE "Red Line Boundary" (fid INTEGER PRIMARY KEY NOT NULL, geometry BLOB, Area REAL);
        CREATE TABLE "Habitats" (fid INTEGER PRIMARY KEY NOT NULL, geom BLOB, "Parcel Ref" TEXT, Area REAL);
        INSERT INTO gpkg_contents VALUES ('Red Line Boundary', 'features', 27700), ('Habitats', 'features', 27700);
        INSERT INTO gpkg_geometry_columns VALUES ('Red Line Boundary', 'geometry', 'POLYGON', 27700), ('Habitats', 'geom', 'MULTIPOLYGON', 27700);
        """
    )
    corners = [0.0, 0.0, float(size), 0.0, float(size), 1.0, 0.0, 1.0, 0.0, 0.0]
    wkb = struct.pack("<BIII10d", 1, 3, 1, 5, *corners)
    blob = b"GP" + bytes([0, 1]) + struct.pack("<i", 27700) + wkb
    db.execute('INSERT INTO "Red Line Boundary" VALUES (1, ?, ?)', (blob, float(size)))
    for n in range(size % 4):
        db.execute('INSERT INTO "Habitats" VALUES (?, ?, ?, ?)', (n + 1, blob, f"H{n + 1:03d}", size / 4))
    content = db.serialize()
    db.close()
    return content


FILES_PER_BATCH = 64
FILES_PER_TASK = 10_000


def _site_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for start in range(0, len(whole), FILES_PER_BATCH):
            batch = whole.iloc[start : start + FILES_PER_BATCH]
            content = [_site_file(*row) for row in zip(batch["p_partkey"], batch["p_name"], batch["p_size"])]
            yield pd.DataFrame({"path": [f"/sites/{k}.gpkg" for k in batch["p_partkey"]], "content": content})


def site_files(spark, folder):
    rows = t.load(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    # few bytes make large files: as many tasks as the files need, not as the table's bytes would get
    tasks = max(spark.sparkContext.defaultParallelism, rows.count() // FILES_PER_TASK)
    return rows.repartition(tasks).mapInPandas(_site_files, "path string, content binary")


@query(
    "scan_geopackages",
    """WITH p AS (SELECT *, '/sites/' || p_partkey || '.gpkg' AS path FROM part)
SELECT path, 'feature' AS record, 'Red Line Boundary' AS table_name, CAST(1 AS BIGINT) AS rows FROM p WHERE p_partkey % 23 <> 0
UNION ALL SELECT path, 'feature', 'Habitats', p_size % 4 FROM p WHERE p_partkey % 23 <> 0 AND p_size % 4 > 0
UNION ALL SELECT path, 'layer', t, 1 FROM p CROSS JOIN (VALUES ('Red Line Boundary'), ('Habitats')) AS v(t) WHERE p_partkey % 23 <> 0
UNION ALL SELECT path, 'geometry', t, 1 FROM p CROSS JOIN (VALUES ('Red Line Boundary'), ('Habitats')) AS v(t) WHERE p_partkey % 23 <> 0
UNION ALL SELECT path, 'column', t, n FROM p CROSS JOIN (VALUES ('Red Line Boundary', 3), ('Habitats', 4)) AS v(t, n) WHERE p_partkey % 23 <> 0
UNION ALL SELECT path, 'table', t, 1 FROM p CROSS JOIN (VALUES ('Red Line Boundary'), ('Habitats'), ('gpkg_contents'),
  ('gpkg_geometry_columns'), ('gpkg_spatial_ref_sys')) AS v(t) WHERE p_partkey % 23 <> 0
UNION ALL SELECT path, CASE WHEN p_partkey % 23 = 0 THEN 'status failed' ELSE 'status ok' END, NULL, 1 FROM p""",
)
def scan_geopackages(spark, folder):
    found = gpkg.scan(site_files(spark, folder))
    record = F.when(F.col("record") == "status", F.concat_ws(" ", "record", "kind")).otherwise(F.col("record"))
    return found.groupBy("path", record.alias("record"), "table_name").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "geopackage_features",
    """SELECT '/sites/' || p_partkey || '.gpkg' AS path, printf('H%03d', n) AS parcel_ref, p_size / 4.0 AS area_m2, 27700 AS srs_id, 93 AS wkb_bytes
FROM part CROSS JOIN (VALUES (1), (2), (3)) AS v(n) WHERE n <= p_size % 4 AND p_partkey % 23 <> 0""",
)
def geopackage_features(spark, folder):
    rows = gpkg.scan(site_files(spark, folder)).where("record = 'feature' AND table_name = 'Habitats'")
    return rows.select(
        "path", gpkg.attribute("Parcel Ref").alias("parcel_ref"), gpkg.attribute("Area", "double").alias("area_m2"),
        "srs_id", F.length("geometry").alias("wkb_bytes"),
    )


@query(
    "file_format_codes",
    """SELECT '/sites/' || p_partkey || '.gpkg' AS path,
  CASE WHEN p_partkey % 23 = 0 THEN 'GPKG_INVALID_FILE' ELSE 'GPKG_NOT_A_GEOPACKAGE' END AS code
FROM part WHERE p_partkey % 23 = 0 OR p_partkey % 19 = 0""",
)
def file_format_codes(spark, folder):
    coded = site_files(spark, folder).withColumn("code", gpkg.stamp_code(F.col("content")))
    return coded.where("code IS NOT NULL").select("path", "code")


@query(
    "file_metadata_faults",
    """SELECT '/sites/' || p_partkey || '.gpkg' AS path, p_partkey || '.gpkg' AS name, 'INVALID_FILE_METADATA' AS code
FROM part WHERE length(p_partkey || '.gpkg') > 8""",
)
def file_metadata_faults(spark, folder):
    """All files against bounds on size and on the length of the name."""
    listed = site_files(spark, folder).select("path", F.length("content").alias("length"))
    return gpkg.metadata_faults(listed, max_bytes=1_000_000_000, max_name=8).select("path", "name", "code")


# -- streams -------------------------------------------------------------------------------


@query(
    "audit_events_once",
    """SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS event_date FROM events""",
)
def audit_events_once(spark, folder):
    """Events landing in files over several triggers, some late and some twice, appended to the lake once each."""
    landing, lake, mark = (scratch_path(spark, n) for n in ("landing", "lake", "mark"))
    events = t.load(spark, folder, "events")
    # files land in turn; repeats and every seventh event come with the last ones, however old they are
    late = F.when(F.col("event_id") % 7 == 0, 3).otherwise(F.col("event_id") % 3)
    landed = events.withColumn("turn", late).unionByName(events.where("event_id % 10 = 0").withColumn("turn", F.lit(3)))
    landed.repartitionByRange(4, "turn").drop("turn").write.parquet(landing)
    audit.append_to_lake(audit.read_events(spark, landing, files_per_trigger=1), lake, mark).awaitTermination()
    return audit.read_lake(spark, lake).select(
        "event_id", "user_id", "event_type", "value", F.date_format("event_date", "yyyy-MM-dd").alias("event_date")
    )


@query(
    "priced_as_they_arrive",
    f"""{q.AREA_PRICED} SELECT retention, count(*) AS parcels, count(post_units) AS priced,
  {q.rounded('sum(post_units)', 3)} AS post_units FROM priced GROUP BY 1""",
)
def priced_as_they_arrive(spark, folder):
    landing, out, mark = (scratch_path(spark, n) for n in ("parcels", "priced", "mark"))
    rows = t.pricing_input(t.parcels(spark, folder))
    rows.write.parquet(landing)
    stream = spark.readStream.schema(rows.schema).parquet(landing)
    live.write_priced(live.price_stream(stream, t.synthetic_lookups(spark)), out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy("retention").agg(
        F.count(F.lit(1)).alias("parcels"), F.count("post_price.units").alias("priced"),
        rounded(F.sum("post_price.units"), 3).alias("post_units"),
    )
