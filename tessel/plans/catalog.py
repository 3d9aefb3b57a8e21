"""Every query of the engine with its SQL twin."""

from __future__ import annotations

from tessel.plans import analytics, documents, flows, indexes, reading, rules, sharing, shelf, stateful, stores, streams, vectors
from tessel.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analytics", "documents", "flows", "indexes", "reading", "rules", "sharing", "shelf", "stateful", "stores", "streams", "vectors"]
