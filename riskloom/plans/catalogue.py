"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from . import activity, datasets, evaluation, links, messages, release

MODULES = [evaluation, datasets, links, messages, activity, release]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
