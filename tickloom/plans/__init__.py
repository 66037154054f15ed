"""The registered queries, each with the SQL that must give the same rows."""

from tickloom.plans import feature_queries, indicator_queries, select_queries, simulation_queries, stream_queries  # noqa: F401
from tickloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
