"""Helpers for operators that hand on the rows they got."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of keys that are broadcast to drop or keep rows; more are joined by a shuffle.
KEYS_MAX = 1_000_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, keys: DataFrame, names: list[str], how: str = "left_anti") -> DataFrame:
    """Rows of ``df`` whose ``names`` are not (or, by left_semi, are) among ``keys``, nulls being equal to nulls.

    ``keys`` should be written, since it is counted: it is broadcast only up to KEYS_MAX rows.
    """
    other = keys.select([F.col(c).alias(f"key {i}") for i, c in enumerate(names)])
    if keys.count() <= KEYS_MAX:
        other = F.broadcast(other)
    same = F.lit(True)
    for i, c in enumerate(names):
        same = same & df[c].eqNullSafe(other[f"key {i}"])
    return df.join(other, same, how)
