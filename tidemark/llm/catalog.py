"""All queries over training data and their check SQL."""

from __future__ import annotations

import corpus_pipeline

from . import queries  # noqa: F401
from .registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]
