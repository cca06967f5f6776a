"""Joins of a large side with a side that holds at most a few rows per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 32 * 1024 * 1024

# Bytes in memory for each byte that the optimizer expects.
PACKED = 4

# A key is "hot" when it holds more than 1/HOT_SHARE of the rows, so there can be
# at most HOT_SHARE hot keys however large the data is.
HOT_SHARE = 1000

# Rows of one key that a task takes in any case.
PLAIN_ROWS = 10_000


def fits_in_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether the optimizer's size estimate for ``df`` and the sizes of what it reads are both within the broadcast bound.

    Estimates start from file sizes, which compression makes too small, and ignore that ``explode`` adds rows, so they
    count PACKED times. They also shrink by each wide column that is made and dropped again (a geometry, its facts) while
    the rows stay, so a plan over large inputs is never taken to be small.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return PACKED * max(int(plan.stats().sizeInBytes()), read) <= max_bytes


def sized_join(many: DataFrame, one: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` that broadcasts ``one`` only within the bound of ``fits_in_broadcast``.

    Spark's own choice compares sizes of compressed files with its threshold and may bring millions of rows to the driver.
    Keys must be spread; ``keyed_join`` is for keys that may not be.
    """
    keys = list(keys)
    if how != "full" and not many.isStreaming and fits_in_broadcast(one):
        return many.join(F.broadcast(one), keys, how)
    return many.join(one.hint("merge"), keys, how)


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys holding more than 1/HOT_SHARE of all rows, with the number of parts to cut each into.

    Keys with a NULL match nothing and are not among them.
    """
    counts = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("rows")).scalar()
    return counts.where(F.col("rows") * HOT_SHARE > total).select(
        *keys, F.ceil(F.col("rows") * HOT_SHARE / total).cast("int").alias("parts")
    )


def is_skewed(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a key is hot and beyond PLAIN_ROWS, or that many rows have a NULL in a key."""
    matching = reduce(and_, [F.col(k).isNotNull() for k in keys])
    rows = F.col("rows")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).select(rows, matching.alias("matching"))
    found = counts.agg(
        F.max(F.when(F.col("matching"), rows)).alias("most"), F.sum(F.when(F.col("matching"), rows)).alias("total"),
        F.sum(F.when(~F.col("matching"), rows)).alias("lost"),
    ).first()
    most = found.most or 0
    return (most > PLAIN_ROWS and most * HOT_SHARE > found.total) or (found.lost or 0) > PLAIN_ROWS


def keyed_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    max_bytes: int = BROADCAST_MAX_BYTES,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` to ``one`` on ``keys`` without letting a hot key land in one task.

    ``one`` is broadcast when its size is within bounds. Otherwise the keys of ``many`` are
    counted, and without skew the join is a plain one. With it, rows of the hot keys are dealt over several parts by a hash of the row, and the matching rows of ``one``
    are copied once per part; all other keys take part 0 only. Rows with a NULL in a key match nothing and are dealt over
    HOT_SHARE parts. A caller that has counted its keys gives ``hot`` (keys, parts), as ``hot_keys`` would. A stream is joined plainly: it cannot be counted, and its batches are small.
    """
    keys = list(keys)
    if many.isStreaming:
        return many.join(one, keys, how)
    if fits_in_broadcast(one, max_bytes):
        return many.join(F.broadcast(one), keys, how)
    if hot is None and not is_skewed(many, keys):
        return many.join(one.hint("merge"), keys, how)
    # names that no caller's column has
    parts, part = "dealt over parts", "dealt to part"
    hot = F.broadcast((hot_keys(many, keys) if hot is None else hot).withColumnRenamed("parts", parts))
    others = [F.col(c) for c in many.columns if c not in keys] or [F.lit(0)]
    dealt = (
        many.join(hot, keys, "left")
        .withColumn(parts, F.when(reduce(or_, [F.col(k).isNull() for k in keys]), HOT_SHARE).otherwise(F.coalesce(parts, F.lit(1))))
        .withColumn(part, F.pmod(F.xxhash64(*others), parts).cast("int"))
        .drop(parts)
    )
    copied = (
        one.join(hot, keys, "left")
        .withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
        .drop(parts)
    )
    return dealt.join(copied.hint("merge"), [*keys, part], how).drop(part)
