"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from tagloom.registry import ORACLES, QUERIES
from tagloom.tasks import comprehensions, extras, files, lifted, programs, workloads

__all__ = ["MODULES", "ORACLES", "QUERIES"]

MODULES = (lifted, workloads, comprehensions, programs, extras, files)
