"""All named queries of the engine."""

from . import catalogue, evidence, framewise, governance, measures, records, search

_MODULES = (catalogue, governance, evidence, measures, records, search, framewise)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
