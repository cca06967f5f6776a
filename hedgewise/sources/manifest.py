"""The scenario manifest: one JSON document, or one line per scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = (
    "id string, purpose string, title string, description string, size int, "
    "subject struct<layer:string,ref:string,note:string>, "
    "files struct<baseline:string,postIntervention:string>, "
    "gain struct<expected:string,percentage:double,netUnitChange:double,baselineUnits:double,"
    "postInterventionUnits:double,met:boolean,priced:bigint,skipped:bigint>"
)
DOCUMENT_SCHEMA = "scenarios array<struct<" + ENTRY_SCHEMA.replace(", ", ",").replace(" ", ":") + ">>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Scenario entries of all manifest documents under ``path``."""
    documents = spark.read.schema(DOCUMENT_SCHEMA).option("multiLine", True).json(path)
    return documents.select(F.posexplode("scenarios").alias("scenario_no", "s")).select("scenario_no", "s.*")


def write_manifest(entries: DataFrame, path: str) -> None:
    """Write entries as one JSON line each; every file is a part of the manifest."""
    entries.drop("scenario_no").write.mode("overwrite").json(path)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries as ``write_manifest`` has written them."""
    return spark.read.schema(ENTRY_SCHEMA).json(path)


def write_index(lines: DataFrame, path: str) -> None:
    """Write index lines as text files that, read in name order, give the whole index."""
    ordered = lines.repartitionByRange("section_no", "line_no").sortWithinPartitions("section_no", "line_no")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
