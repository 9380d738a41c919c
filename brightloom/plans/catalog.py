"""All queries on the test tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from . import analysis, cases, landed, ledger, reports, warehouse

QUERIES = warehouse.QUERIES | analysis.QUERIES | reports.QUERIES | ledger.QUERIES | landed.QUERIES | cases.QUERIES
SQL = warehouse.SQL | analysis.SQL | reports.SQL | ledger.SQL | landed.SQL | cases.SQL
