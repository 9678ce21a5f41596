"""Registry of the core queries: one entry per operator, with its SQL where SQL can express it."""

from __future__ import annotations

from quillon.plans import conversations, corpora, events, learned, reviews, stores, verification

_MODULES = (conversations, events, corpora, stores, reviews, verification, learned)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
