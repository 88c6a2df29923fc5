"""Quadrille: knowledge-graph queries and question-dataset governance on Spark DataFrames."""

from .engine import execute_select, format_value, handle_chat, health, query_frame, render_rows
from .errors import BenchmarkError, CatalogueError, CatalogueValidationError, CoverageError, CurationError, DatasetError, GraphError, QueryGenerationError, SparqlError
from .functions.text import normalize
from .plans.guard import validate_select

__all__ = [
    "BenchmarkError", "CatalogueError", "CatalogueValidationError", "CoverageError", "CurationError", "DatasetError", "GraphError", "QueryGenerationError",
    "SparqlError", "execute_select", "format_value", "handle_chat", "health", "normalize", "query_frame", "render_rows", "validate_select",
]
