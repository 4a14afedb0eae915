"""Importing this package registers every query."""

from . import (  # noqa: F401
    evaluation_queries, model_queries, outcome_queries, quality_queries, sequence_queries, streaming_queries,
    window_queries,
)
from .registry import ORACLES, QUERIES  # noqa: F401
