"""Stored layers, sheets, lists and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedgewise.functions.scalars import trimmed

SAMPLE_SCHEMA = "label string, elapsed_ms double, success boolean"


def read_layer(
    spark: SparkSession, folder: str, layer: str, columns: Sequence[str] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """A layer stored as Parquet partitioned by ``stage``; filters on partitions prune folders."""
    rows = spark.read.parquet(f"{folder}/{layer}")
    if where is not None:
        rows = rows.where(where)
    return rows.select(*columns) if columns else rows


def write_layer(df: DataFrame, folder: str, layer: str, partitions: Sequence[str] = ("stage",)) -> None:
    """Write a layer, replacing only the partitions present in ``df``."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions).parquet(f"{folder}/{layer}")
    )


def read_sheet(spark: SparkSession, path: str, schema: str, form: str = "csv") -> DataFrame:
    """An exported workbook sheet with a fixed schema; a row that does not fit is kept and marked.

    ``problem`` names the columns whose text is not of their type, NULL for good rows, so
    one broken export neither fails the job nor disappears.
    """
    if form == "parquet":
        return spark.read.schema(schema).parquet(path).withColumn("problem", F.lit(None).cast("string"))
    kinds = dict(field.strip().split(None, 1) for field in schema.split(","))
    texts = spark.read.schema(", ".join(f"{n} string" for n in kinds)).option("header", True).csv(path)
    misfits = [
        F.when(F.col(n).isNotNull() & F.col(n).try_cast(kind).isNull(), F.lit(n)) for n, kind in kinds.items()
    ]
    problem = F.nullif(F.concat_ws(", ", *misfits), F.lit(""))
    return texts.select(*[F.col(n).try_cast(kind).alias(n) for n, kind in kinds.items()], problem.alias("problem"))


def sheet_status(sheet: DataFrame, source: Column) -> DataFrame:
    """Rows read and rows that did not fit per source; a failed source leaves the rest alone."""
    return sheet.groupBy(source.alias("source")).agg(
        F.count_if(F.col("problem").isNull()).alias("read"), F.count_if(F.col("problem").isNotNull()).alias("failed")
    ).withColumn("status", F.when(F.col("failed") == 0, "ok").otherwise("failed rows"))


def list_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of an annotated list: trimmed, without blank and ``#`` lines."""
    return (
        lines.withColumn("entry", trimmed(F.col(column)))
        .where((F.col("entry") != "") & ~F.startswith("entry", F.lit("#")))
        .drop(column)
    )


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return list_entries(spark.read.text(path).select("value"))


def split_lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Load-test samples from CSV files with a header."""
    return spark.read.schema(SAMPLE_SCHEMA).option("header", True).csv(path)
