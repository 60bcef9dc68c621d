"""Imports every query module so the registry is complete."""

from tillbook.plans import change_queries, delta_queries, io_queries, metadata_queries, money_queries, reject_queries, summary_queries, view_queries  # noqa: F401
from tillbook.plans.registry import ORACLES, QUERIES  # noqa: F401
