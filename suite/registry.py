"""All registered queries and the SQL that checks them."""

from suite import analysis, flows, learning, series, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for part in (tables, analysis, series, learning, flows):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)
