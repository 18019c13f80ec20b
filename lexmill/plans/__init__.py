"""The queries over the test tables."""

from __future__ import annotations

import importlib

MODULES = ("text", "dedup", "corpus", "select", "measure", "vectors", "reports", "more", "whole")


def _all() -> list:
    return [importlib.import_module(f"lexmill.plans.{m}").r for m in MODULES]


def queries() -> dict:
    return {n: q for r in _all() for n, q in r.queries.items()}


def oracle_sql() -> dict:
    return {n: s for r in _all() for n, s in r.oracle.items()}
