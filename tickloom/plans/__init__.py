"""The registered queries, module by module."""

from __future__ import annotations

import importlib

MODULES = ("bar_queries", "metric_queries", "run_queries", "backtest_queries", "robustness_queries", "leaderboard_queries", "profile_queries", "review_queries", "more_queries", "genome_queries", "result_queries", "state_queries", "choice_queries", "sampler_queries")


def all_queries() -> dict:
    """name -> (Spark query, DuckDB statement or None)."""
    from tickloom.plans.registry import REGISTERED

    for m in MODULES:
        importlib.import_module(f"tickloom.plans.{m}")
    return REGISTERED
