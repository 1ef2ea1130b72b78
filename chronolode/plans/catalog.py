"""All queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from chronolode.plans import search, services

QUERIES = {**search.QUERIES, **services.QUERIES}
ORACLES = {**search.ORACLES, **services.ORACLES}
