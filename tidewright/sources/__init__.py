"""Readers of tables and dataset slices."""

from tidewright.sources.tables import table

__all__ = ["table"]
