"""Market time-series analytics on PySpark."""

__version__ = "0.1.0"

#: Names the set of record schemas in tickloom.schemas; raise it when one of them changes.
SCHEMA_REV = "2026-11-r1"
