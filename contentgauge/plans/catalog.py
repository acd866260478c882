"""All registered queries. Importing a module below registers what it holds."""

from contentgauge.plans import descriptors, feed_queries, formats, people, relational, scale_queries  # noqa: F401
from contentgauge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
