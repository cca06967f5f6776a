"""The common shape of rule violations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = ["site_id", "stage"]
COLUMNS = [*SITE, "group", "code", "layer", "feature_ref", "detail"]


def violation(
    df: DataFrame,
    group: str,
    code: str | Column,
    layer: str | Column | None = None,
    feature_ref: Column | None = None,
    detail: Column | None = None,
) -> DataFrame:
    """Rows of ``df`` as violations."""

    def text(value):
        if value is None:
            return F.lit(None).cast("string")
        return F.lit(value) if isinstance(value, str) else value.cast("string")

    return df.select(
        *SITE,
        F.lit(group).alias("group"),
        text(code).alias("code"),
        text(layer).alias("layer"),
        text(feature_ref).alias("feature_ref"),
        text(detail).alias("detail"),
    )


def union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
