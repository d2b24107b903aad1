"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from .plans import camera, chunks, clips, geometry, jobs, positions, tracking  # noqa: F401  they register
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
