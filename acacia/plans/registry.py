"""All registered queries and their SQL twins, by name."""

from __future__ import annotations

from acacia.plans import catalog, records, shapes

assert records and shapes  # they register their queries with the others
QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
