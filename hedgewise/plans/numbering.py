"""Consecutive numbers within a group that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgewise.plans.joins import PLAIN_ROWS, keyed_join, sized_join
from hedgewise.plans.scratch import written


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    slices: Mapping[str, Column],
    most: int = PLAIN_ROWS,
) -> DataFrame:
    """Add ``out`` = 1, 2, … within ``keys`` in ``order``.

    Groups of up to ``most`` rows are sorted whole, which takes one shuffle of the rows. ``slices`` are columns, coarse to
    fine, that never decrease along ``order``: larger groups are cut into (keys, slices) cells, each small enough for one
    task. Rows with a NULL in a key or a slice count but are left out. ``order`` must be total, so that a recomputed task
    gives the same numbers.
    """
    keys = list(keys)
    crowded = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).select(*keys)
    crowded = written(crowded, "crowded-keys")
    if crowded.isEmpty():
        return _numbered_whole(df, keys, order, out, slices)
    small = _numbered_whole(keyed_join(df, crowded, keys, "left_anti"), keys, order, out, slices)
    return small.unionByName(_numbered_by_cells(keyed_join(df, crowded, keys, "left_semi"), keys, order, out, slices))


def _numbered_whole(df: DataFrame, keys: list[str], order: Sequence[str], out: str, slices: Mapping[str, Column]) -> DataFrame:
    given = reduce(and_, [c.isNotNull() for c in (*map(F.col, keys), *slices.values())])
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, number.cast("long")).where(given)


def _numbered_by_cells(df: DataFrame, keys: list[str], order: Sequence[str], out: str, slices: Mapping[str, Column]) -> DataFrame:
    """Counts per cell are aggregated first (map-side partial), turned into running offsets level by level, and only the
    cells themselves are sorted."""
    names = list(slices)
    sliced = df.withColumns(dict(slices))
    counts = sliced.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("rows"))
    offsets = counts
    for depth, name in enumerate(names):
        outer = [*keys, *names[:depth]]
        level = offsets if depth == len(names) - 1 else counts.groupBy(*outer, name).agg(
            F.sum("rows").alias("rows")
        )
        before = Window.partitionBy(*outer).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn(f"before_{depth}", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        if depth < len(names) - 1:
            offsets = sized_join(offsets, level.drop("rows"), [*outer, name])
        else:
            offsets = level
    offset = sum((F.col(f"before_{d}") for d in range(1, len(names))), F.col("before_0"))
    offsets = offsets.select(*keys, *names, offset.alias("before"))
    in_cell = Window.partitionBy(*keys, *names).orderBy(*order)
    return (
        sized_join(sliced, offsets, [*keys, *names])
        .withColumn(out, (F.col("before") + F.row_number().over(in_cell)).cast("long"))
        .drop("before", *names)
    )
