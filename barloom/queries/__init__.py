"""All registered queries and their SQL."""

from __future__ import annotations

from barloom.queries import backtest, files, layers, live, market, pages, scoring, series, state, tables, validation

MODULES = (series, scoring, backtest, market, state, pages, validation, tables, layers, live, files)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
