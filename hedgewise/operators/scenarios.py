"""Scenario catalogue run as one job: generate, derive the baseline, verify, price, record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewise.functions.scalars import hectares, scenario_base_name
from hedgewise.operators.generate import generate, override_rows, scenario_seed
from hedgewise.operators.lookups import AREA, Lookups
from hedgewise.operators.netgain import gain_mismatches, net_gain
from hedgewise.operators.pricing import price
from hedgewise.operators.shape_rules import with_facts
from hedgewise.schema import LAYER_TABLES

DEFAULT_SIZE = 6
CENTRE = (530_000.0, 180_000.0)


def scenario_sites(scenarios: DataFrame, seed: int) -> DataFrame:
    """One site per scenario; its seed depends on the run's seed and the scenario's id only."""
    return scenarios.select(
        F.col("scenario_no").alias("site_id"), "id",
        F.coalesce("size", F.lit(DEFAULT_SIZE)).cast("long").alias("parcels"),
        scenario_seed(seed, F.col("id")).alias("seed"),
        F.lit(CENTRE[0]).alias("x"), F.lit(CENTRE[1]).alias("y"),
    )


def scenario_features(
    scenarios: DataFrame, overrides: DataFrame, seed: int,
    habitats: list[str], conditions: list[str], hedges: list[str], rivers: list[str],
) -> DataFrame:
    """Generated features with each scenario's attribute overrides applied."""
    sites = scenario_sites(scenarios, seed)
    return override_rows(generate(sites, habitats, conditions, hedges, rivers), overrides)


def scenario_gains(scenarios: DataFrame, features: DataFrame, lookups: Lookups) -> DataFrame:
    """Net gain of the scenarios that expect one; other scenarios are not priced."""
    expecting = scenarios.where("expected IS NOT NULL").select(
        F.col("scenario_no").alias("site_id"), "expected"
    )
    parcels = features.where(F.col("layer") == LAYER_TABLES["habitats"]).join(expecting, "site_id", "left_semi")
    sized = with_facts(parcels).withColumn("size", hectares(F.col("area")))
    return net_gain(price(sized, lookups, AREA)).join(expecting, "site_id")


def manifest_entries(scenarios: DataFrame, gains: DataFrame) -> DataFrame:
    """Manifest rows in the document's nested shape, with ``scenario_no`` for their order."""
    gain = F.struct(
        F.col("g.expected").alias("expected"),
        F.col("g.net_gain_pct").alias("percentage"),
        F.col("g.net_unit_change").alias("netUnitChange"),
        F.col("g.baseline_units").alias("baselineUnits"),
        F.col("g.post_units").alias("postInterventionUnits"),
        F.col("g.met").alias("met"),
        F.col("g.priced").alias("priced"),
        F.col("g.skipped").alias("skipped"),
    )
    base = scenario_base_name(F.col("s.purpose"), F.col("s.id"))
    folder = F.concat("s.purpose", F.lit("/"), base)
    files = F.struct(
        F.concat(folder, F.lit("-baseline.gpkg")).alias("baseline"),
        F.concat(folder, F.lit("-post-intervention.gpkg")).alias("postIntervention"),
    )
    joined = scenarios.alias("s").join(gains.alias("g"), F.col("g.site_id") == F.col("s.scenario_no"), "left")
    return joined.select(
        "s.scenario_no", "s.id", "s.purpose", "s.title", "s.description",
        F.coalesce("s.size", F.lit(DEFAULT_SIZE)).alias("size"), "s.subject", files.alias("files"),
        F.when(F.col("g.expected").isNotNull(), gain).alias("gain"),
    )


def failed_scenarios(gains: DataFrame) -> DataFrame:
    """Scenarios whose gain lands on the other side of the threshold than declared."""
    return gain_mismatches(gains)
