"""Small literal tables that Catalyst knows the exact size of."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, schema: str, rows: Iterable[Sequence]) -> DataFrame:
    """A DataFrame over inline rows.

    ``VALUES`` becomes a LocalRelation, so its statistics are exact and size-checked
    broadcasts work on it; a Python-parallelised frame would report an unknown size.
    """
    fields = [part.strip().split(None, 1) for part in schema.split(",")]
    rows = list(rows)
    casts = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(fields))
    aliases = ", ".join(f"c{i}" for i in range(len(fields)))
    if rows:
        values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
        return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({aliases})")
    nulls = ", ".join("NULL" for _ in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES ({nulls}) AS t({aliases}) WHERE false")
