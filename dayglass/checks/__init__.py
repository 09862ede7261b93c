"""The registered queries, one per operator, with their SQL twins."""

from importlib import import_module

_MODULES = ("profile_checks", "cleaning_checks", "scoring_checks", "encoding_checks", "feature_checks", "model_checks", "job_checks", "tree_checks")


def _merge(attribute: str) -> dict:
    merged: dict = {}
    for name in _MODULES:
        merged.update(getattr(import_module(f"dayglass.checks.{name}"), attribute))
    return merged


def all_queries() -> dict:
    return _merge("QUERIES")


def all_sql() -> dict:
    return _merge("SQL")
