"""All queries and their SQL twins."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from doppel.session import tune

GROUPS = ["integrity", "privacy", "association", "profile", "generate", "synthesis", "fidelity", "memorisation", "relational",
          "sources", "documents", "events", "reports"]


def _tuned(fn):
    @wraps(fn)
    def run(spark, sf_dir):
        return fn(tune(spark), sf_dir)
    return run


QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _group in GROUPS:
    _module = import_module(f"catalog.{_group}")
    QUERIES.update({name: _tuned(fn) for name, fn in _module.QUERIES.items()})
    ORACLES.update(_module.ORACLES)
