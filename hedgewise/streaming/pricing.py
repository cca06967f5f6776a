"""Parcels priced as they arrive; lookups are static sides of the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from hedgewise.operators.lookups import AREA, Lookups
from hedgewise.operators.pricing import price


def price_stream(parcels: DataFrame, lookups: Lookups, kind: str = AREA) -> DataFrame:
    """Stateless: every row is priced by joins with static tables, broadcast where they are small."""
    return price(parcels, lookups, kind)


def write_priced(priced: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append priced rows to Parquet; totals are then an ordinary batch aggregate."""
    return (
        priced.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

