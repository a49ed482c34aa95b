"""Registered queries with their SQL, module by module."""

from . import corpus, evaluation, printed, stored, streams

_MODULES = (corpus, evaluation, printed, stored, streams)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: f for m in _MODULES for k, f in m.ORACLE_SQL.items()}
