"""All registered queries and their check SQL."""

from __future__ import annotations

from . import (  # noqa: F401
    cohort_queries, evaluation_queries, feature_queries, job_queries, model_queries, relational_queries, text_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
