"""PySpark library for a catalog of discovered web sites."""

from sitelode.schema import TABLES, table_schema

__all__ = ["TABLES", "table_schema"]
