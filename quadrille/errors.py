"""All errors are ValueErrors, one class for each part that can refuse its input."""


class SparqlError(ValueError):
    """A query breaks the contract, or cannot be parsed, compiled or executed."""


class QueryGenerationError(ValueError):
    """A generator could not turn a question into a query."""


class DatasetError(ValueError):
    """A question dataset breaks its contract."""


class BenchmarkError(ValueError):
    """A benchmark file or its predictions break their contract."""


class CatalogueError(ValueError):
    """A catalogue of query families is malformed."""


class CatalogueValidationError(ValueError):
    """A catalogue does not fit its graph or inventory."""


class CoverageError(ValueError):
    """Coverage requirements are malformed or not met."""


class CurationError(ValueError):
    """Staged rows cannot be assembled."""


class GraphError(ValueError):
    """A graph file cannot be read."""
