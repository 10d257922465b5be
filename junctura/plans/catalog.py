"""Registry of the queries over the driver's tables: name -> (Spark plan over the domain views, oracle text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .binding import Views

Plan = Callable[[Views], DataFrame]
_QUERIES: dict[str, tuple[Plan, str | None]] = {}


def query(name: str, oracle: str | None = None):
    """Registers a plan under a name."""

    def add(plan: Plan) -> Plan:
        assert name not in _QUERIES, name
        _QUERIES[name] = (plan, oracle)
        return plan

    return add


def _load() -> None:
    from . import cohort, files, kernels, joining, ordering, projections, tests_of_association  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, sf_dir, plan=plan: plan(Views(spark, sf_dir))) for n, (plan, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: text for n, (_, text) in _QUERIES.items() if text}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer events paired from all samples' breakpoints."""
    return queries()["j06_event_pairs"](spark, sf_dir)
