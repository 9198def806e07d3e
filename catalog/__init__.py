"""Queries over the given tables, each with the SQL that must agree with it where SQL can say it."""

from __future__ import annotations

import importlib

NAMES = ["links", "text", "places", "categories", "feeds", "records", "output", "contacts", "pages", "runs"]
_MODULES = [importlib.import_module(f"catalog.{name}") for name in NAMES]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
