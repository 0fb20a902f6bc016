"""All core queries with their SQL."""

from __future__ import annotations

from . import edges, maps, prose, scans, wide

MODULES = [wide, scans, edges, prose, maps]


def queries():
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles():
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}


def flagship(spark, d):
    return queries()["j1_shared_parts_pruned"](spark, d)
