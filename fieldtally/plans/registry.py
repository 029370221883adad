"""All registered queries of the survey library, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, further, grounded, lifecycle, published, relational, scalars, staged, surveyed, tracked

Query = Callable[[SparkSession, str], DataFrame]
_ALL = relational.Q | tracked.Q | scalars.Q | surveyed.Q | published.Q | further.Q | files.Q | lifecycle.Q | grounded.Q | staged.Q


def queries() -> dict[str, Query]:
    """Name to query."""
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    """Name to SQL."""
    return {name: text for name, (_, text) in _ALL.items() if text}
