"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import q_export, q_io, q_lineage, q_more, q_seam, q_text, q_vectors

_ALL = q_text.QUERIES | q_vectors.QUERIES | q_lineage.QUERIES | q_export.QUERIES | q_more.QUERIES | q_io.QUERIES | q_seam.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
