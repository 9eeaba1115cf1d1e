"""All registered (query, oracle SQL) pairs, gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("ranklab.plans.reg_eval", "ranklab.plans.reg_data", "ranklab.plans.reg_scoring",
           "ranklab.plans.reg_models", "ranklab.plans.reg_rules")


def _gather():
    queries, oracle = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        for k in mod.QUERIES:
            if k in queries:
                raise ValueError(f"duplicate query name {k}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries():
    return _gather()[0]


def oracle_sql():
    return _gather()[1]
