"""Every driver query and its DuckDB twin, gathered from the plan modules."""

from __future__ import annotations

from . import (cost_scenarios, cursor_scenarios, event_scenarios, geo_scenarios, grain_scenarios, history_scenarios, proof_scenarios,
               run_scenarios, state_scenarios)


def _modules():
    mods = [cost_scenarios, event_scenarios, geo_scenarios, run_scenarios, history_scenarios, proof_scenarios,
            cursor_scenarios, grain_scenarios, state_scenarios]
    return mods


def all_queries() -> dict:
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
