"""Registered queries over the reference tables and their SQL."""

from chronofold.plans import queries_graph, queries_ingest, queries_merge, queries_offsets, queries_rules, queries_tools  # noqa: F401
from chronofold.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
