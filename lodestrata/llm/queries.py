"""All corpus queries and their SQL, by name."""

from __future__ import annotations

import importlib

MODULES = ["similar", "distinctive", "neardup", "tokens", "packing", "handwritten", "credentials", "docpairs", "spam", "markup", "hostruns"]

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"lodestrata.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
