"""All queries of the core."""

from __future__ import annotations

from lodestrata.plans import corpus, deliveries, general, keyed, records

_PLANS = [general, corpus, records, deliveries, keyed]
QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE = {name: sql for plan in _PLANS for name, sql in plan.ORACLE.items()}
