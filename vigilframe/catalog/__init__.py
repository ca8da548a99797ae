"""Registered queries, each next to the SQL it must agree with."""

from vigilframe.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "load"]


def load() -> None:
    """Import every module that registers queries."""
    from vigilframe.catalog import (  # noqa: F401
        calibration,
        cleaning,
        evaluation,
        functions,
        models,
        monitoring,
        reports,
        sampling,
        sources,
        streams,
        windows,
    )
