"""All core queries with the SQL each is compared with."""

from __future__ import annotations

from importlib import import_module

_PARTS = ("audit", "nested", "evaluation", "manifests", "measures", "pictures", "rules")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _PARTS:
    _m = import_module(f"granary.plans.{_name}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
