"""Query names, their callables and their DuckDB oracles."""

from . import answers, answers_json, cases, checks, documents, fixtures, layouts, rules, streams, texts

_MODULES = (cases, texts, fixtures, documents, checks, answers, answers_json, streams, layouts, rules)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict = {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
