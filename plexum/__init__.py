"""plexum: a PySpark engine for comparing populations of graphs."""

from __future__ import annotations

import importlib

#: Public names and the modules that have them; modules are imported when a name is first used.
_PUBLIC = {
    "plexum.plans.experiment": ("Dataset", "Experiment", "run_experiment", "run_debug_experiment", "run_full_experiment", "merge_runs", "debug_experiment", "full_experiment", "replication_experiment", "ba_pilot_experiment", "er_pilot_experiment", "molecule_run", "register_workflow", "default_workers", "acceleration_summary"),
    "plexum.plans.evaluation": ("evaluate_results",),
    "plexum.plans.figures": ("generate",),
    "plexum.operators.evaluate": ("evaluation_summary", "final_matrix", "failure_map"),
    "plexum.sources.results": ("read_results", "write_table", "discover_runs"),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name in _HOME:
        return getattr(importlib.import_module(_HOME[name]), name)
    raise AttributeError(name)
