"""Runs requests: incremental transformations and raw queries."""

from tidewright.plans.raw import execute_raw_query
from tidewright.plans.transform import execute_transform

__all__ = ["execute_raw_query", "execute_transform"]
