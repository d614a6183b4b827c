"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks import (q_clean, q_cohort, q_labs, q_metrics, q_scalars, q_simulation, q_timeline,
                    q_windows)

MODULES = (q_clean, q_scalars, q_windows, q_labs, q_cohort, q_timeline, q_simulation, q_metrics)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, fn in m.Q.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.Q.oracles.items()}
