"""All registered queries."""

from . import benchmark_queries, box_queries, conversation_queries  # noqa: F401
from . import evaluation_queries, raster_queries, source_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
