"""Declarative row decisions and data-processing operators on Spark DataFrames."""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_EXPORTS = {
    "compile_yaml": "verdigris.sources.ruleset_yaml",
    "compile_yaml_file": "verdigris.sources.ruleset_yaml",
    "compile_payload": "verdigris.sources.ruleset_yaml",
    "export_yaml": "verdigris.sources.ruleset_export",
    "evaluate": "verdigris.plans.evaluation",
    "coverage": "verdigris.plans.coverage",
    "FunctionRegistry": "verdigris.functions.registry",
    "FunctionSpec": "verdigris.functions.registry",
    "ArgSpec": "verdigris.functions.registry",
    "standard_registry": "verdigris.functions.standard",
    "RulesetStore": "verdigris.sources.store",
    "RulesService": "verdigris.plans.service",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    """Resolve public names on first use, so that importing the package stays cheap."""
    if name in _EXPORTS:
        return getattr(importlib.import_module(_EXPORTS[name]), name)
    raise AttributeError(name)
