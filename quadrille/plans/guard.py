"""The guard in front of query execution: ordered checks, the first failure wins, nothing is repaired."""

from __future__ import annotations

import re

from ..errors import SparqlError
from .parser import parse_select

MAX_QUERY_CHARS = 4096
#: Words that may not occur anywhere in the text, inside literals and names too.
FORBIDDEN = ("SERVICE", "FROM", "INSERT", "DELETE", "LOAD", "CLEAR", "CREATE", "DROP", "COPY", "MOVE", "ADD", "WITH")
_FORBIDDEN = re.compile(rf"\b({'|'.join(FORBIDDEN)})\b", re.IGNORECASE)


def validate_select(query: object) -> str:
    """The query without surrounding white space; raises SparqlError with the first broken rule."""
    if not isinstance(query, str):
        raise SparqlError("a SPARQL query must be text")
    text = query.strip()
    if text == "":
        raise SparqlError("the SPARQL query is empty")
    if len(text) > MAX_QUERY_CHARS:
        raise SparqlError(f"the SPARQL query exceeds {MAX_QUERY_CHARS} characters")
    if not re.match(r"SELECT\b", text, re.IGNORECASE):
        raise SparqlError("only SELECT queries are allowed")
    if re.match(r"SELECT\s+(?:(?:DISTINCT|REDUCED)\s+)?\*", text, re.IGNORECASE):
        raise SparqlError("SELECT * is not allowed: name the columns of the answer")
    if word := _FORBIDDEN.search(text):
        raise SparqlError(f"SPARQL keyword is not allowed: {word.group(1).upper()}")
    parse_select(text)
    return text
