"""The registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import analytics, decide, edits, fitting, geometry, hue_grids, imaging, jobs, kernels, knowledge, looping, measure, records, reviewing, scalars, sequences, streams, texts, toning, trails, white_balances

_MODULES = (decide, sequences, knowledge, measure, analytics, scalars, streams, edits, geometry, jobs, kernels, reviewing, trails, toning, records, imaging, hue_grids, white_balances, fitting, looping, texts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
