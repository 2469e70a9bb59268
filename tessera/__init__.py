"""Code-structure analytics and corpus operators on PySpark.

The names below are the library's interface; each is imported from its module when it is first used, so that importing the package costs nothing.
"""

from __future__ import annotations

from importlib import import_module

_NAMES = {
    "sources.python_source": ["modules", "modules_of", "parse_module"],
    "sources": ["language", "languages", "register_language"],
    "sources.config_scan": ["config_points"],
    "sources.snapshots": ["BadSnapshot", "read_findings", "read_labels", "read_lock", "read_points"],
    "sources.walk": ["packages", "parse_table"],
    "operators.graph": ["dependencies", "flatten_seams", "resolve_imports", "runtime_sites", "subclassable"],
    "operators.scoring": ["points", "score_seams"],
    "operators.ranking": ["ranked", "split_points", "tie_bounds", "tie_note", "tied_with", "top"],
    "operators.diff": ["manifest_diff", "surface_diff"],
    "operators.evaluate": ["label_ranks", "scores"],
    "operators.crosscheck": ["tolerance_match", "votes"],
    "operators.facts": ["enrich", "fact_text", "manifest", "scaffold_text"],
    "plans.detect": ["audit", "detect", "edges", "scan", "seams"],
    "plans.docs": ["Budget", "BudgetSpent", "Cache", "FakeProvider", "Provider", "Report", "document", "provider", "register_provider", "write_docs", "write_manifest", "write_scaffolds"],
    "plans.validate": ["preflight", "run_example", "tally", "validate_point", "validate_points", "verify_scaffolds"],
    "plans.trees": ["facts_of", "findings_of", "points_of", "score_trees", "usage_of"],
    "functions.render": ["audit_json", "audit_markdown", "config_markdown", "detect_json", "detect_markdown", "manifest_markdown", "score_markdown", "surface_markdown"],
    "session": ["discard", "local_session"],
}
_HOME = {name: f"{__name__}.{module}" for module, names in _NAMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    value = getattr(import_module(_HOME[name]), name)
    globals()[name] = value
    return value


def __dir__() -> list[str]:
    return sorted([*globals(), *__all__])
