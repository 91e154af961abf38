"""Every registered query of the engine, with its SQL twin where SQL can express it."""

from __future__ import annotations

from tidewell.plans import cycle, desk, evaluation, market, posts, sentiment

_MODULES = (market, posts, sentiment, evaluation, desk, cycle)

QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
