"""Workbook rows: splits, pairing, fresh refs and strict filtering, as data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from hedgewise.operators import workbook as wb
from hedgewise.plans import literal_table

HAB = "site_id long, ref int, broad string, type string, distinctiveness string, condition string, strategic_significance string, area double, area_retained double, area_enhanced double, area_lost double"
NEW = "site_id long, ref int, broad string, type string, distinctiveness string, condition string, strategic_significance string, area double, advance_years int, delay_years int"
ENH = "site_id long, baseline_ref int, proposed_broad string, proposed_type string, proposed_distinctiveness string, proposed_condition string, proposed_strategic_significance string, advance_years int, delay_years int"
HEDGE = "site_id long, ref int, type string, distinctiveness string, condition string, strategic_significance string, length_m double, length_retained_m double, length_enhanced_m double, length_lost_m double"


def rank(df, out):
    return df.withColumn(out, F.row_number().over(Window.partitionBy("site_id").orderBy("ref")).cast("long"))


def hab(site, ref, retained=1.0, enhanced=0.0, lost=0.0):
    return (site, ref, "Grassland", "Modified grassland", "Low", "Moderate", "Low", 1.0, retained, enhanced, lost)


def new(site, ref, area):
    return (site, ref, "Woodland and forest", "Other woodland; broadleaved", "Medium", "Good", "Low", area, 0, 0)


def test_habitats(spark):
    base = literal_table(
        spark, HAB,
        [hab(1, 1), hab(2, 1, 0.4, 0.6), hab(3, 1, 0.0, 0.0, 1.0), hab(4, 1), hab(4, 2), hab(4, 3), hab(5, 1, 0.0, 1.0)],
    )
    made = literal_table(spark, NEW, [new(3, 1, 0.9), new(4, 99, 0.2)])
    better = literal_table(
        spark, ENH,
        [(2, 1, "Woodland and forest", "Other woodland; broadleaved", "Medium", "Good", "High", 2, 1), (5, 1, None, None, None, "Good", None, None, None)],
    )
    rows = {(r.site_id, r.ref): r for r in wb.post_rows(base, made, better, "habitats", rank).collect()}
    assert len(rows) == 9
    assert rows[1, "H001"].retention == "Retained" and rows[1, "H001"].prop_broad == "Grassland"
    assert (rows[2, "H001a"].retention, rows[2, "H001a"].amount) == ("Retained", 0.4)
    assert (rows[2, "H001b"].retention, rows[2, "H001b"].amount, rows[2, "H001b"].advance_years) == ("Enhanced", 0.6, 2)
    paired = rows[3, "H001"]
    assert (paired.retention, paired.amount, paired.baseline_ref, paired.base_type) == ("Created", 0.9, "1", "Modified grassland")
    fresh = rows[4, "H004"]
    assert (fresh.baseline_ref, fresh.retention, fresh.base_broad) == (None, "Created", "Woodland and forest")
    assert rows[5, "H001"].retention == "Enhanced"


def test_hedgerows_and_trees(spark):
    base = literal_table(
        spark, HEDGE,
        [(1, 1, "Native", "High", "Moderate", "Low", 100.0, 30.0, 70.0, 0.0), (2, 1, "Native", "High", "Moderate", "Low", 50.0, 0.0, 0.0, 0.0)],
    )
    none = literal_table(spark, NEW, []).drop("broad").withColumnRenamed("area", "length_m")
    better = literal_table(spark, ENH, [(1, 1, None, "Hedgerow with trees", None, "Good", None, None, None)])
    rows = {(r.site_id, r.ref): r for r in wb.post_rows(base, none, better, "hedgerows", rank).collect()}
    assert [(k, r.retention, r.amount) for k, r in sorted(rows.items())] == [
        ((1, "HG001a"), "Retained", 30.0), ((1, "HG001b"), "Enhanced", 70.0), ((2, "HG001"), "Retained", 50.0),
    ]
    assert rows[1, "HG001b"].prop_type == "Hedgerow with trees"
    trees = literal_table(spark, HAB, [hab(1, 1), hab(2, 1, 0.0, 0.0, 1.0)])
    made = literal_table(spark, NEW, [new(1, 99, 1.0)])
    found = sorted((r.site_id, r.ref, r.retention) for r in wb.post_rows(trees, made, None, "trees", rank).collect())
    assert found == [(1, "T001", "Retained"), (1, "T002", "Created")]


def test_baseline_and_strict(spark):
    base = literal_table(spark, HAB, [hab(1, 12), (1, 2, "Bogus", "None", "Low", "Moderate", "Low", 1.0, 1.0, 0.0, 0.0)])
    assert {(r.ref, r.baseline_ref) for r in wb.baseline_rows(base, "habitats").collect()} == {("H012", "12"), ("H002", "2")}
    assert not {"retention", "prop_type"} & set(wb.baseline_rows(base, "habitats").columns)
    metric = literal_table(spark, "broad string, type string, condition string", [("Grassland", "Modified grassland", "Moderate")])
    kept, skipped = wb.strict_habitats(base, metric)
    assert kept.count() == 1 and "ref 2" in skipped.collect()[0].reason
