"""All registered queries: importing the query modules fills the registry."""

from __future__ import annotations

import importlib

from quarry.plans.registry import ORACLE, QUERIES

MODULES = ("q_clean", "q_profile", "q_series", "q_explog", "q_eval", "q_models", "q_corpus", "q_io")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"quarry.plans.{m}")


def queries():
    load()
    return dict(QUERIES)


def oracle_sql():
    load()
    return dict(ORACLE)
