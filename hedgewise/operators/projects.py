"""Project documents and the geometry rows they point at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROJECT_SCHEMA = "layers array<struct<layer:string,geometryRef:bigint>>"


def project_references(projects: DataFrame, document: str = "document") -> DataFrame:
    """One row per geometry a project's JSON document refers to; a broken document gives none."""
    parsed = projects.withColumn("parsed", F.from_json(document, PROJECT_SCHEMA))
    return parsed.select("project_id", F.explode("parsed.layers").alias("r")).select(
        "project_id", F.col("r.layer").alias("layer"), F.col("r.geometryRef").alias("geometry_ref")
    )


def project_geometries(projects: DataFrame, geometries: DataFrame, document: str = "document") -> DataFrame:
    """The geometry rows of each project; ``geometries`` is keyed by ``geometry_ref``."""
    return project_references(projects, document).join(geometries, "geometry_ref")
