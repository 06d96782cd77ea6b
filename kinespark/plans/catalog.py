"""Imports every query module so that the registry is complete."""

from kinespark.plans import q_errors, q_geometry, q_jobs, q_models, q_select, q_series, q_sources  # noqa: F401
from kinespark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
