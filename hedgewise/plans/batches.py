"""Bounds on what passes between Spark and Python at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession


def bounded_batches(spark: SparkSession, rows: int, size: int) -> None:
    """Keep the session's Arrow batches within ``rows`` and ``size`` bytes; smaller settings stay as they are."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        said = spark.conf.get(name).lower().rstrip("b")
        now = int(said.rstrip("kmgtp") or 0) << 10 * ("kmgtp".find(said[-1:] or "-") + 1)
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
