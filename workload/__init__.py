"""Queries over the given tables that exercise every operator, and their SQL counterparts."""

from workload import generation, pairs, pricing, scalars, storage, validation, workbook  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
