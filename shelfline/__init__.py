"""Retail inventory and order analytics as Spark DataFrame operators."""

from shelfline.schema import SCHEMAS, load_tables

__all__ = ["SCHEMAS", "load_tables"]
