"""Running queries and answering questions."""

from __future__ import annotations

import logging
import time
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import QueryGenerationError, SparqlError
from .functions.text import normalize
from .plans.compiler import Answer, Compiler
from .plans.guard import validate_select
from .plans.parser import parse_select
from .plans.solution import column
from .plans.terms import INTEGERS, XSD, lexical

#: What is said when nothing is found, and the marker a generator gives for a question out of scope.
NO_INFORMATION_REPLY = "Không có thông tin."
NO_INFORMATION_MARKER = "không có thông tin"
Primitive = str | int | float | bool | None
QueryRow = dict[str, Primitive]
log = logging.getLogger(__name__)


def compile_query(graph, query: str, checked: bool = True) -> Answer:
    """``query`` as a DataFrame plan over ``graph`` (a TripleStore or a MappedGraph)."""
    text = validate_select(query) if checked else query
    return Compiler(graph.spark, graph).select(parse_select(text))


def query_frame(graph, query: str) -> DataFrame:
    """The answer as a DataFrame of plain columns, without a row limit."""
    return compile_query(graph, query).frame()


def _python(t, name: str) -> Primitive:
    if t is None:
        return None
    if t["k"] != 2:
        raise SparqlError(f"answer column ?{name} holds a graph node: select a label or another literal")
    lex, dt = t["lex"], t["dt"]
    try:
        if dt in INTEGERS:
            return int(lex)
        if dt in (XSD + "double", XSD + "float"):
            return float(lex)
        if dt == XSD + "boolean" and lex in ("true", "false", "1", "0"):
            return lex in ("true", "1")
    except ValueError:
        pass
    return lex


def execute_select(graph, query: str, *, max_rows: int = 100) -> list[QueryRow]:
    """Rows of plain values. More than ``max_rows`` rows is an error, not a cut; at most one row more is fetched."""
    if max_rows < 1:
        raise ValueError("max_rows must be positive")
    answer = compile_query(graph, query)
    nodes = [n for n in answer.names if answer.reps[n].kind == "node"]
    cols = [(lexical(F.col(column(n)), answer.reps[n]) if answer.reps[n].kind in ("dec", "time", "node") else F.col(column(n))).alias(n) for n in answer.names]
    try:
        rows = answer.df.select(*cols).limit(max_rows + 1).collect()
    except SparqlError:
        raise
    except Exception as e:
        raise SparqlError(f"SPARQL execution failed: {e}") from e
    if len(rows) > max_rows:
        raise SparqlError(f"the SPARQL result exceeds {max_rows} rows")
    for n in nodes:
        if any(r[n] is not None for r in rows):
            raise SparqlError(f"answer column ?{n} holds a graph node: select a label or another literal")
    return [{n: _python(r[n], n) if answer.reps[n].kind == "term" else r[n] for n in answer.names} for r in rows]


def format_value(value: Primitive) -> str:
    return "—" if value is None else str(value)


def render_rows(rows: list[QueryRow]) -> str:
    """Rows as the text of a reply: one value bare, several as a list, columns as ``name: value``."""
    if not rows:
        return NO_INFORMATION_REPLY
    names = list(rows[0])
    if any(list(r) != names for r in rows):
        raise ValueError("all rows must have the same columns")
    lines = [format_value(r[names[0]]) if len(names) == 1 else "; ".join(f"{n}: {format_value(r[n])}" for n in names) for r in rows]
    return lines[0] if len(lines) == 1 else "\n".join(f"- {x}" for x in lines)


def render_frame(df: DataFrame, order: list[str]) -> DataFrame:
    """(reply): the same text built by Spark, rows in the order of the columns ``order``. At most what a reply shows."""
    from pyspark.sql import types as T

    def shown(c: str):
        kind = df.schema[c].dataType
        text = F.initcap(F.col(c).cast("string")) if isinstance(kind, T.BooleanType) else F.col(c).cast("string")
        return F.coalesce(text, F.lit("—"))

    line = shown(df.columns[0]) if len(df.columns) == 1 else F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), shown(c)) for c in df.columns])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"])
    many = F.array_join(F.transform(F.col("l"), lambda x: F.concat(F.lit("- "), x)), "\n")
    return df.agg(lines.alias("l")).select(F.when(F.size("l") == 0, NO_INFORMATION_REPLY).when(F.size("l") == 1, F.col("l")[0]).otherwise(many).alias("reply"))


class QueryGenerator(Protocol):
    """Turns a normalised question into a query, or into NO_INFORMATION_MARKER."""

    def generate(self, text: str) -> str: ...


class QuestionAnswerer:
    """question -> normalised text -> query -> rows -> reply; each stage is logged with its time."""

    def __init__(self, generator: QueryGenerator, graph, max_rows: int = 100):
        self.generator, self.graph, self.max_rows = generator, graph, max_rows

    def answer(self, question: str) -> str:
        stage, began = "normalise", time.perf_counter()
        try:
            text = normalize(question)
            log.info("question normalised: %s", text)
            stage = "generate"
            query = self.generator.generate(text)
            if query.strip() == NO_INFORMATION_MARKER:
                log.info("out of scope after %.3f s", time.perf_counter() - began)
                return NO_INFORMATION_REPLY
            stage = "execute"
            rows = execute_select(self.graph, query, max_rows=self.max_rows)
            stage = "render"
            reply = render_rows(rows)
            log.info("answered with %d rows after %.3f s", len(rows), time.perf_counter() - began)
            return reply
        except Exception:
            log.exception("stage %s failed after %.3f s", stage, time.perf_counter() - began)
            raise


def handle_chat(answerer: QuestionAnswerer, payload: object) -> tuple[int, dict[str, str]]:
    """(status, body) for a chat request: 400 for no question, the fallback reply for a query that fails; other errors surface."""
    message = payload.get("message") if isinstance(payload, dict) else None
    if not isinstance(message, str) or not message.strip():
        return 400, {"error": "message must be a non-empty string"}
    try:
        return 200, {"reply": answerer.answer(message)}
    except (SparqlError, QueryGenerationError):
        return 200, {"reply": NO_INFORMATION_REPLY}


def health() -> tuple[int, dict[str, str]]:
    return 200, {"status": "ok"}
