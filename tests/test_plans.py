"""Skew-safe joins, numbering, trimming and percentiles against plain equivalents."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from hedgewise.functions import reproject, scalars
from hedgewise.operators import reporting
from hedgewise.operators.netgain import net_gain
from hedgewise.operators.reporting import exact_percentile
from hedgewise.operators.validate import fit_to_compare
from hedgewise.plans import keyed_join, literal_table, numbered, scratch_path
from hedgewise.streaming import audit


def skewed(spark, rows=6000):
    """A third of all rows on one key."""
    return spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 701 + 1).alias("site_id"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"), F.col("id").alias("b"),
    )


def test_keyed_join_beyond_broadcast(spark):
    many = skewed(spark)
    one = spark.range(500).select(F.col("id").alias("site_id"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_anti", "left_semi"):
        salted = keyed_join(many, one, ["site_id"], how, max_bytes=-1)
        plain = many.join(one, ["site_id"], how)
        assert sorted(salted.collect()) == sorted(plain.select(*salted.columns).collect()) if how != "left" else (
            sorted(map(str, salted.collect())) == sorted(map(str, plain.select(*salted.columns).collect()))
        )


def test_keyed_join_with_null_keys(spark):
    many = skewed(spark).withColumn("site_id", F.when(F.col("b") % 2 == 0, F.col("site_id")))
    one = spark.range(500).select(F.when(F.col("id") > 3, F.col("id")).alias("site_id"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_anti", "left_semi"):
        salted, plain = keyed_join(many, one, ["site_id"], how, max_bytes=-1), many.join(one, ["site_id"], how)
        assert salted.columns == plain.columns
        assert sorted(map(str, salted.collect())) == sorted(map(str, plain.collect()))


def test_faults_take_out_their_feature_and_unreadable_rows_their_layer(spark):
    names = "site_id string, stage string, layer string, feature_ref string, status string, fault string"
    rows = [
        ("a", "s", "Habitats", "1", "ok", None), ("a", "s", "Habitats", "2", "ok", "SELF_CROSSING"),
        ("a", "s", "Hedgerows", "3", "unreadable", None), ("a", "s", "Hedgerows", "4", "ok", None),
        ("b", "s", "Hedgerows", "5", "ok", None),
    ]
    kept = fit_to_compare(spark.createDataFrame(rows, names))
    assert {r.feature_ref for r in kept.collect()} == {"1", "5"}


def test_late_and_repeated_events_reach_the_lake_once(spark):
    lake = scratch_path(spark, "lake")
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 20), 1, "x", 1.0, None) for i in range(40)]
    batch = spark.createDataFrame(rows, audit.EVENT_SCHEMA)
    for k, part in enumerate((batch.where("event_id > 9"), batch.where("event_id < 20"), batch)):  # ever later, and once more
        audit.add_batch(part, k, lake)
    assert sorted(r.event_id for r in audit.read_lake(spark, lake).collect()) == list(range(40))


def test_a_batch_that_dies_between_its_files_is_not_read_and_runs_again(spark):
    lake = scratch_path(spark, "lake")
    rows = [(i, datetime.datetime(2024, 1, 1 + i % 5), 1, "x", 1.0, None) for i in range(30)]
    batch = spark.createDataFrame(rows, audit.EVENT_SCHEMA)
    audit.add_batch(batch.where("event_id < 10"), 0, lake)
    second = batch.where("event_id >= 5")
    # what a batch leaves that dies after some of its files: part of its dates, and no commit record
    part = audit.unseen(second, lake).where("event_date < '2024-01-03'")
    part.write.partitionBy("event_date").parquet(f"{lake}/batch_id=1")
    assert sorted(r.event_id for r in audit.read_lake(spark, lake).collect()) == list(range(10))
    for _ in range(2):  # the second time after it was committed
        audit.add_batch(second, 1, lake)
    assert sorted(r.event_id for r in audit.read_lake(spark, lake).collect()) == list(range(30))


def test_summary_tells_empty_labels_from_totals(spark):
    rows = [("", 10.0, True), ("b", 20.5, True), (None, 30.25, False)]
    found = reporting.sample_summary(spark.createDataFrame(rows, "label string, elapsed_ms double, success boolean")).collect()
    assert sorted((str(r.label), r.samples, round(r.p95_ms, 3)) for r in found) == [
        ("", 1, 10.0), ("None", 1, 30.25), ("None", 3, 29.275), ("b", 1, 20.5),
    ]


def test_numbered_matches_row_number(spark):
    rows = skewed(spark)
    ours = numbered(
        rows, ["site_id"], ["a", "b"], "n", {"s1": F.floor(F.col("a") / 100), "s2": F.col("a")}
    )
    plain = rows.withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy("a", "b")).cast("long"))
    assert sorted(ours.collect()) == sorted(plain.collect())


def test_numbered_cuts_only_crowded_keys(spark):
    """Keys beyond the bound by cells, the others whole; rows with a null in a key or a slice count but are left out."""
    rows = skewed(spark).withColumn("a", F.when(F.col("b") % 50 != 7, F.col("a")))
    rows = rows.unionByName(rows.limit(20).withColumn("site_id", F.lit(None).cast("long")))
    slices = {"s1": F.floor(F.col("a") / 100), "s2": F.col("a")}
    whole = rows.withColumn("n", F.row_number().over(Window.partitionBy("site_id").orderBy("a", "b")).cast("long"))
    whole = whole.where("site_id IS NOT NULL AND a IS NOT NULL")
    for most in (0, 500, 10_000):
        assert sorted(numbered(rows, ["site_id"], ["a", "b"], "n", slices, most).collect()) == sorted(whole.collect())


def test_numbered_shuffles_small_groups_once(spark):
    rows = numbered(skewed(spark), ["site_id"], ["a", "b"], "n", {"s": F.col("a")})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_significant_matches_exact_rounding(spark):
    random.seed(1)
    values = [random.uniform(1e-7, 10.0 ** random.randint(-6, 9)) for _ in range(3000)] + [0.0, 991.4536285714285, 8724.444333333335]
    rows = literal_table(spark, "v double", [(v,) for v in values])
    for row in rows.select("v", scalars.significant(F.col("v")).alias("t")).collect():
        assert row.t == float(f"{row.v:.14e}"), row


def test_percentile_of_a_hot_label(spark):
    rows = skewed(spark).select(F.when(F.col("site_id") == 0, "hot").otherwise("rest").alias("label"), (F.col("a") / 7).alias("v"))
    got = {r.label: r.p for r in exact_percentile(rows, ["label"], "v", 0.95, "p").collect()}
    for label in ("hot", "rest"):
        data = [r.v for r in rows.where(F.col("label") == label).collect()]
        assert abs(got[label] - np.percentile(data, 95)) < 1e-9


def test_percentiles_narrow_to_any_range(spark):
    rng = random.Random(6)
    groups = {
        "within one": [rng.random() for _ in range(3000)],
        "wide": [rng.uniform(-1e12, 1e12) for _ in range(3000)],
        "far out": [rng.random() for _ in range(2999)] + [1e12],
        "greatest": [rng.choice([-1, 1]) * rng.uniform(0, 1.7e308) for _ in range(500)],
        "one value": [5.0] * 700,
        "single": [2.5],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("single", None), ("single", float("nan")), ("none", None)]
    samples = spark.createDataFrame(rows, "label string, v double").repartition(3)
    for share in (0.95, 0.0, 1.0):
        got = {r.label: r.p for r in exact_percentile(samples, ["label"], "v", share, "p", cells=16, small=20).collect()}
        assert set(got) == set(groups)
        for label, values in groups.items():
            assert got[label] == pytest.approx(np.percentile(values, 100 * share), rel=1e-12, abs=1e-12), (label, share)


def test_net_gain_does_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = []
    for site in range(40):  # exactly ten percent on paper, in parts that doubles do not hold
        parts = [rng.randrange(1, 10**6) / 1000 for _ in range(50)]
        rows += [(site, v, float(f"{v * 1.1:.14e}")) for v in parts]
    units = spark.createDataFrame(rows, "site_id long, before double, after double")
    priced = units.select("site_id", F.struct(F.col("before").alias("units")).alias("base_price"), F.struct(F.col("after").alias("units")).alias("post_price"))
    runs = {str(sorted(tuple(r) for r in net_gain(priced.repartition(k, "after")).collect())) for k in (1, 3, 7, 11)}
    assert len(runs) == 1


def test_years_and_labels(spark):
    texts = ["5 yrs", "30+", "", None, " -3x", "x4", "99999999999999999999"]
    rows = literal_table(spark, "n int, t string", list(enumerate(texts)))
    assert [r.y for r in rows.orderBy("n").select(scalars.years(F.col("t")).alias("y")).collect()] == [5, 30, 0, 0, -3, 0, 2**63 - 1]
    labels = literal_table(spark, "v double", [(293.008,), (None,), (0.0,)]).select(scalars.percentage_label(F.col("v")).alias("l"))
    assert {r.l for r in labels.collect()} == {"293.0%", "n/a", "0.0%"}


def test_reprojection_of_the_published_point(spark):
    rows = literal_table(spark, "e double, n double", [(651409.903, 313177.270)])
    point = reproject.to_wgs84(rows, "e", "n").collect()[0]
    # 52 39 28.72 N, 1 42 57.79 E on WGS84, good to the few metres of the seven-parameter shift.
    assert abs(point.lat - 52.657979) < 1e-4 and abs(point.lon - 1.716051) < 1e-4
