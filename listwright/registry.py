"""All queries of the library and their oracle SQL, by name."""

from __future__ import annotations

from listwright.plans import q_export, q_feeds, q_listings, q_match, q_normalize, q_paged, q_runs, q_similar, q_streams, q_text  # noqa: F401  they register themselves
from listwright.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
