"""Roll-up of priced parcels to net gain per site, and the threshold test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NET_GAIN_THRESHOLD_PERCENT = 10.0
#: Units are added up in this type: exact, hence the same in whatever order rows come.
SUMMED = "decimal(38,18)"


def meets_net_gain(percentage: Column) -> Column:
    return F.coalesce(percentage >= NET_GAIN_THRESHOLD_PERCENT, F.lit(False))


def net_change(baseline: Column, post: Column) -> dict[str, Column]:
    """Net unit change and its percentage; a zero baseline has no percentage."""
    change = post - baseline
    return {"net_unit_change": change, "net_gain_pct": F.try_divide(change, baseline) * 100}


def net_gain(priced: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Totals per site over the rows that both sides could price, in one aggregate.

    Totals do not depend on how rows are dealt over tasks, so neither does a site that stands exactly at the threshold.
    """
    units = priced.select(
        *keys, F.col("base_price.units").alias("before"), F.col("post_price.units").alias("after")
    )
    before, after = F.col("before"), F.col("after")
    both = before.isNotNull() & after.isNotNull()
    totals = units.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when(both, side.cast(SUMMED))).cast("double"), F.lit(0.0)).alias(name)
            for side, name in ((before, "baseline_units"), (after, "post_units"))
        ],
        F.count_if(both).alias("priced"),
        F.count_if(~both).alias("skipped"),
    )
    return totals.withColumns(net_change(F.col("baseline_units"), F.col("post_units"))).withColumn(
        "met", meets_net_gain(F.col("net_gain_pct"))
    )


def gain_mismatches(gains: DataFrame) -> DataFrame:
    """Rows whose expectation (``met``/``unmet``) the computed gain does not confirm."""
    found = F.when(F.col("met"), "met").otherwise("unmet")
    return gains.where(F.col("expected").isNotNull() & (F.col("expected") != found)).withColumn("found", found)
