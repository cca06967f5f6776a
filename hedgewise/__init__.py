"""Biodiversity-unit accounting over habitat layers, written as Spark DataFrame jobs."""
