"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexgrain.plans import covered as _covered  # noqa: F401 registers its queries
from lexgrain.plans import pipelines as _pipelines  # noqa: F401 registers its queries
from lexgrain.plans import planted as _planted  # noqa: F401 registers its queries
from lexgrain.plans import queries as _q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_q.SQL)
