"""All registered queries of the library's own operators, with their oracle SQL."""

from __future__ import annotations

from helixframe.plans import basics, iterative, relational, unrolled

QUERIES = relational.QUERIES | iterative.QUERIES
#: One table: each of the modules adds to it.
ORACLE_SQL = relational.ORACLE_SQL
assert basics.ORACLE_SQL is unrolled.ORACLE_SQL is ORACLE_SQL
