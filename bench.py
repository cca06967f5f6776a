"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload import QUERIES  # noqa: E402

HEADLINE = [
    "net_gain_by_site",
    "price_area_parcels",
    "price_watercourses",
    "pair_check_failures",
    "workbook_habitats_post",
    "parcel_overlaps",
    "parcels_outside_redline",
    "structure_violations",
    "validate_submissions",
    "sample_summary",
    "grid_to_wgs84",
    "scan_geopackages",
]


def split(spark: SparkSession, folder: str, files: int) -> str:
    """The tables as several files each, as tables of any size are; the given ones are one row group and so one task."""
    out = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{folder}/{name}").repartition(files).write.parquet(f"{out}/{name}")
    return out


def main() -> None:
    given = folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    folder = split(spark, folder, int(cpus))
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(given.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
