"""Registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.plans import census_queries, element_queries, figure_queries, layout_queries, merge_queries, resolve_queries, segment_queries, stream_queries, text_queries, version_queries

_MODULES = (segment_queries, census_queries, element_queries, figure_queries, layout_queries, text_queries, resolve_queries, merge_queries, version_queries, stream_queries)
FLAGSHIP = "m1_three_way_rows"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
