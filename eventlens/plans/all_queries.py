"""Imports every query module so that the registry is complete."""

from eventlens.plans import (  # noqa: F401
    queries_behavior,
    queries_chain,
    queries_cloud,
    queries_detect,
    queries_lifecycle,
    queries_protect,
    queries_search,
    queries_stream,
)
from eventlens.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
