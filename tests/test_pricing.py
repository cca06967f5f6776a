"""Published worked examples of unit pricing and net gain."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from hedgewise.operators import lookups as lk
from hedgewise.operators.netgain import net_gain
from hedgewise.operators.pricing import price
from hedgewise.plans import literal_table

MODIFIED = "Grassland - Modified grassland"
SALTMARSH = "Coastal saltmarsh - Saltmarshes and saline reedbeds"
SCRUB = "Heathland and shrub - Hazel scrub"
CALCAREOUS = "Grassland - Lowland calcareous grassland"
ORCHARD = "Grassland - Traditional orchards"
NEUTRAL = "Grassland - Other neutral grassland"
CEREAL = "Cropland - Cereal crops"
RIVER, DITCH, HEDGE = "Other rivers and streams", "Ditches", "Native hedgerow"
NA = "Condition Assessment N/A"

# Years the documents do not state, set to any value that agrees with the worked examples.
ASSUMED_CREATE = [
    (lk.AREA, MODIFIED, "Poor", 1), (lk.AREA, SCRUB, "Poor", 1), (lk.AREA, CALCAREOUS, "Poor", 1),
    (lk.AREA, ORCHARD, "Good", 30), (lk.AREA, ORCHARD, "Poor", 5),
    (lk.WATERCOURSE, RIVER, "Poor", 5), (lk.WATERCOURSE, DITCH, "Poor", 5), (lk.HEDGEROW, HEDGE, "Poor", 1),
]
ASSUMED_ENHANCE = [
    (lk.AREA, SALTMARSH, "Poor", SALTMARSH, "Good", 10), (lk.AREA, CALCAREOUS, "Poor", CALCAREOUS, "Good", 10),
]


@pytest.fixture(scope="module")
def lookups(spark):
    base = lk.published_lookups(spark)
    return dataclasses.replace(
        base,
        years_create=base.years_create.unionByName(literal_table(spark, lk.YEARS_CREATE_SCHEMA, ASSUMED_CREATE)),
        years_enhance=base.years_enhance.unionByName(literal_table(spark, lk.YEARS_ENHANCE_SCHEMA, ASSUMED_ENHANCE)),
    )


SCHEMA = (
    "n int, size double, base_name string, base_condition string, prop_name string, prop_condition string, "
    "retention string, advance_raw string, delay_raw string, prop_encroachment string, prop_riparian string"
)


def run(spark, lookups, kind, cases):
    none = "No Encroachment"
    rows = [(i, 1.0, *c, none, f"{none}/{none}") for i, c in enumerate(cases)]
    priced = price(literal_table(spark, SCHEMA, rows), lookups, kind).orderBy("n").collect()
    return [r.post_price for r in priced], [r.base_price for r in priced]


def created(name, condition, advance=0, delay=0, label="Lost"):
    return (MODIFIED, "Poor", name, condition, label, str(advance), str(delay))


def test_baseline_and_retained(spark, lookups):
    post, base = run(
        spark, lookups, lk.AREA,
        [(MODIFIED, "Moderate", None, None, "Retained", "0", "0"), (SALTMARSH, "Good", None, None, "Retained", "", None)],
    )
    assert [b.units for b in base] == [4.0, 18.0]
    assert [p.units for p in post] == [4.0, 18.0]
    assert post[0].time is None and post[0].difficulty is None and post[0].band is None


def test_created_saltmarsh_timing(spark, lookups):
    shifts = [(0, 0), (0, 5), (0, 20), (1, 0), (7, 0), (8, 0), (15, 0)]
    post, _ = run(spark, lookups, lk.AREA, [created(SALTMARSH, "Good", *s) for s in shifts])
    assert [p.units for p in post] == [
        3.48093685467, 2.91294786519, 1.899592612434, 7.323685641774, 9.06913391121, 14.0269645206, 18.0,
    ]
    assert [p.difficulty for p in post] == [0.33, 0.33, 0.33, 0.67, 0.67, 1.0, 1.0]
    assert [p.time for p in post][:3] == [0.5860163055, 0.4903952635, 0.3197967361]


def test_created_other_habitats(spark, lookups):
    names = [(MODIFIED, "Good", 0, 0), (SCRUB, "Good", 0, 0), (CALCAREOUS, "Good", 0, 0), (ORCHARD, "Good", 30, 0), (CEREAL, NA, 1, 0)]
    post, _ = run(spark, lookups, lk.AREA, [created(*n) for n in names])
    assert [p.units for p in post] == [4.6756548402, 4.71157109622, 2.91294786519, 18.0, 2.0]


def test_enhanced(spark, lookups):
    cases = [
        (MODIFIED, "Moderate", MODIFIED, "Good", "Enhanced", a, d) for a, d in (("0", "0"), ("0", "10"), ("10", "0"))
    ] + [(h, "Poor", h, "Good", "Enhanced", "0", "0") for h in (SALTMARSH, CALCAREOUS)]
    post, _ = run(spark, lookups, lk.AREA, cases)
    assert [p.units for p in post][:3] == [5.4005645484, 4.980790527, 6.0]
    assert [p.standard_years for p in post][:3] == [10, 10, 10]
    assert [p.band for p in post] == ["Low", "Low", "Low", "Medium", "High"]


def test_refusals(spark, lookups):
    cases = [
        created(SALTMARSH, "Good", 5, 5), created(SALTMARSH, NA), created("Not A Real Habitat", "Good"),
        created(CEREAL, NA), created(SALTMARSH, "Good", 31, 0), created(MODIFIED, "Good", label="Created"),
    ]
    post, base = run(spark, lookups, lk.AREA, cases)
    reasons = [p.reject for p in post]
    assert reasons[0].startswith("Advance (5) and delay (5) years cannot both be used on the same habitat.")
    assert reasons[1] == f"Condition '{NA}' is not a valid condition for habitat: {SALTMARSH}"
    assert reasons[2] == "Habitat 'Not A Real Habitat' is not a valid habitat"
    assert reasons[3] == f"Time to target 'Not Possible' for habitat: {CEREAL}, endCondition: Poor"
    assert "30" in reasons[4] and "not priced" in reasons[5]
    assert all(p.units is None for p in post) and all(b.units == 2.0 for b in base)


def test_linear(spark, lookups):
    hedges, base = run(
        spark, lookups, lk.HEDGEROW,
        [(HEDGE, "Moderate", HEDGE, "Good", "Created", "0", d) for d in ("0", "10")],
    )
    assert base[0].units == 4.0 and [p.units for p in hedges] == [3.9127221642, 2.7400099752]
    rivers, _ = run(
        spark, lookups, lk.WATERCOURSE,
        [(RIVER, "Poor", h, "Good", "Created", a, "0") for h, a in ((RIVER, "0"), (RIVER, "3"), (RIVER, "30"), (DITCH, "0"), (DITCH, "3"))],
    )
    assert [p.units for p in rivers] == [4.159676708748, 9.398066228802, 12.06, 5.630269484568, 9.3513096804]


def test_encroachment_missing(spark, lookups):
    rows = [(i, 1.0, RIVER, "Poor", RIVER, "Good", r, "0", "0", None, None) for i, r in enumerate(("Created", "Retained", "Lost"))]
    post = [r.post_price for r in price(literal_table(spark, SCHEMA, rows), lookups, lk.WATERCOURSE).orderBy("n").collect()]
    assert post[0].reject.startswith("Encroachment missing") and post[1].units == 6.0 and post[2].units is None


def test_net_gain_met_and_zero(spark, lookups):
    areas = [1.0, 10.7268, 20.0, 15.0, 9.0, 10.0]
    rows = [
        (i, a, MODIFIED, "Poor", NEUTRAL, "Good", "Enhanced", "0", "0", None, None) for i, a in enumerate(areas)
    ] + [(9, 1.0, "Unknown", "Poor", NEUTRAL, "Good", "Retained", "0", "0", None, None)]
    rows = literal_table(spark, SCHEMA, rows).withColumn("site_id", F.when(F.col("n") == 9, 2).otherwise(1))
    gains = {r.site_id: r for r in net_gain(price(rows, lookups)).collect()}
    assert gains[1].net_gain_pct == pytest.approx(293.00815274999957, abs=1e-9)
    assert gains[1].met and gains[1].priced == 6
    assert gains[2].net_gain_pct is None and not gains[2].met and gains[2].skipped == 1
