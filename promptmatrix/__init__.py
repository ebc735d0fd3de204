"""Evaluation of prompts and models as one lazy Spark plan.

Test cases x prompt variants x models become a table of cells; cells are
rendered, completed, scored, aggregated and gated with DataFrame operators.

Names are looked up when first used: a Python worker that needs one module of
the package does not load all of it.
"""

from __future__ import annotations

from importlib import import_module
from typing import Any

__version__ = "0.3.0"

_MODULES = {
    "errors": "ConfigError ContentError MatrixError ProviderError ScoringError SourceError StoreError TemplateError",
    "functions.text": "hash_case_id",
    "operators.results": "redacted",
    "operators.scoring": "compare gate judged matrix overall",
    "plans.run": "Outcome Selection Tally cells dry_run estimate fingerprint load_cases rescore run run_async selection_note",
    "sources.files": "RESULT",
    "sources.paged": "CaseSource Page",
    "sources.store": "Store",
    "spec": "Case Config Settings load parse",
}
_PLACES = {name: (module, name) for module, names in _MODULES.items() for name in names.split()}
_PLACES |= {"export_run": ("export", "write"), "resolve_settings": ("settings", "resolve")}

__all__ = sorted(_PLACES)  # noqa: PLE0605


def __getattr__(name: str) -> Any:
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    module, own = _PLACES[name]
    found = globals()[name] = getattr(import_module(f"{__name__}.{module}"), own)
    return found


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
