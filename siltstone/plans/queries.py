"""All queries of the library's own operators."""

from __future__ import annotations

from . import arrays, chains, files, formats, groups, rows, scans, scores, structures  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
