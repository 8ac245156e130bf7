"""Every query of the library with its SQL."""

from __future__ import annotations

from orequarry.plans import mining, relational, scalars, structures

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (relational, scalars, mining, structures):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
