"""Many query texts at once: texts that differ in constants only become one plan over a table of these constants.

A text's shape is the text with its plain strings, whole numbers and names of the graph's own namespace cut out; that is done by column
functions on all texts. The driver sees one text of each shape. Its syntax tree tells which of the constants may vary (subjects and
objects of patterns, operands of comparisons in the outer group); they become variables that a table of slots binds. The
others (predicates, classes, limits, arguments of functions, anything in MINUS, VALUES or a sub-query) stay in the plan and tell shapes further apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ast as A
from .guard import FORBIDDEN, MAX_QUERY_CHARS
from .parser import NAMESPACE, parse_select
from .solution import Binding, Solution, column
from .terms import DOUBLES, INTEGERS, XSD, Rep, decimal_text, lexical

CASE = "_case"
#: The tokens of the language as the lexer knows them; what is no token is one by itself and fails in the parser.
_TOKEN = (
    r"(?sU)[ \t\r\n]+|#[^\r\n]*|<[^<>\"{}|^`\\\x00-\x20]*>|[?$]\w+"
    r'|"""(?:[^\\]|\\.)*?"""|' + r"'''(?:[^\\]|\\.)*?'''" + r'|"(?:[^"\\\r\n]|\\.)*"' + r"|'(?:[^'\\\r\n]|\\.)*'"
    r"|@[A-Za-z]+(?:-[A-Za-z0-9]+)*|(?=[0-9.\d])(?:(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)|_:\w(?:[\w.-]*\w)?"
    r"|(?:[\p{L}][a-zA-Z0-9_\w.-]*+)?:(?:(?:\w|%[0-9A-Fa-f]{2})(?:[\w.:-]*[\w:-])?)?|[A-Za-z_][A-Za-z0-9_]*|."
)
_MARK = "\x01"
#: Constants that stand for the k-th slot while a shape is parsed.
_NUMBER = 910_000_000_000_000
_NAME = "Cut-Out-Token-"
_COMPARE = {"&&", "||", "!", "=", "!=", "<", "<=", ">", ">=", "+", "-", "*", "/", "in", "not in"}


def _slot_kind(token: Column) -> Column:
    # The first character tells which pattern to try: most tokens take none.
    return (
        F.when(token.startswith('"'), F.when(token.rlike(r'^"[^"\\\r\n]*"$'), "s"))
        .when((token >= "0") & (token < ":"), F.when(token.rlike(r"^[0-9]{1,18}$"), "i"))
        .when(token.startswith(":"), F.when(token.rlike(r"(?U)^:[\w%.:-]+$"), "n"))
    )


def guard_error(text: Column) -> Column:
    """The first of the guard's rules on the words of a text that it breaks, null for none; ``text`` is trimmed."""
    forbidden = F.regexp_extract(text, rf"(?iU)\b({'|'.join(FORBIDDEN)})\b", 1)
    return (
        F.when(text == "", "the SPARQL query is empty")
        .when(F.length(text) > MAX_QUERY_CHARS, f"the SPARQL query exceeds {MAX_QUERY_CHARS} characters")
        .when(~text.rlike(r"(?i)^SELECT\b"), "only SELECT queries are allowed")
        .when(text.rlike(r"(?i)^SELECT\s+(?:(?:DISTINCT|REDUCED)\s+)?\*"), "SELECT * is not allowed: name the columns of the answer")
        .when(forbidden != "", F.concat(F.lit("SPARQL keyword is not allowed: "), F.upper(forbidden)))
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_shapes(texts: DataFrame, query: str = "query") -> DataFrame:
    """``texts`` with ``problem`` (of the guard), ``shape`` and ``parts``, the tokens that were cut out, in order."""
    kind = lambda t: _slot_kind(t)
    blank = lambda t: (t == " ") | (t < "$") & t.rlike(r"^[ \t\r\n]|^#")
    shown = lambda t: F.when(blank(t), " ").otherwise(F.coalesce(F.concat(F.lit(_MARK), kind(t)), t))

    # Bound as arguments, the trimmed text, its problem and its tokens are worked out once each; columns would be once a use.
    def of(text: Column) -> Column:
        return _let(guard_error(text), lambda problem: _let(F.when(problem.isNull(), F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))), lambda tokens: with_tokens(problem, tokens)))

    def with_tokens(problem: Column, tokens: Column) -> Column:
        return F.struct(problem.alias("problem"), F.array_join(F.transform(tokens, shown), "").alias("shape"), F.filter(tokens, lambda t: kind(t).isNotNull()).alias("parts"))

    text = F.regexp_replace(F.coalesce(F.col(query), F.lit("")), r"(?U)^\s+|\s+$", "")
    return texts.withColumn("__of", _let(text, of)).select(*texts.columns, "__of.problem", "__of.shape", "__of.parts")


@dataclass(frozen=True)
class Shape:
    """A parsed shape: ``kinds`` of its cut-out tokens, and the numbers of those that may vary."""

    tree: A.Select
    kinds: str
    slots: frozenset[int]


def _marked(shape: str) -> tuple[str, str]:
    """The shape as a text with one constant of its own for each token cut out, and the kinds of these."""
    first, *rest = shape.split(_MARK)
    kinds = "".join(r[0] for r in rest)
    stand = {"s": lambda k: f'"{_NAME}{k}"', "i": lambda k: str(_NUMBER + k), "n": lambda k: f":{_NAME}{k}"}
    return first + "".join(stand[r[0]](k) + r[1:] for k, r in enumerate(rest)), kinds


def _number_of(x: object) -> int | None:
    """The slot that a constant of a marked tree stands for."""
    if isinstance(x, A.Iri) and x.value.startswith(NAMESPACE + _NAME):
        return int(x.value.removeprefix(NAMESPACE + _NAME))
    if isinstance(x, A.Lit) and x.lang is None:
        if x.dt == XSD + "string" and x.lex.startswith(_NAME):
            return int(x.lex.removeprefix(_NAME))
        if x.dt == XSD + "integer" and len(x.lex) == len(str(_NUMBER)) and int(x.lex) >= _NUMBER:
            return int(x.lex) - _NUMBER
    return None


def _plain(path: object) -> bool:
    if isinstance(path, A.Sequence):
        return all(map(_plain, path.parts))
    return _plain(path.path) if isinstance(path, A.Inverse) else isinstance(path, A.Iri | A.Var)


def _varied(g: A.Group, made: Callable[[int], A.Var], outer: bool) -> A.Group:
    """The group with a variable in place of each constant that may vary. Operands of filters may in the outer group only."""

    def node(x):
        k = _number_of(x)
        return x if k is None else made(k)

    def expression(e):
        if isinstance(e, A.Op) and e.name in _COMPARE:
            return replace(e, args=tuple(expression(a) for a in e.args))
        if isinstance(e, A.Exists):
            return replace(e, group=_varied(e.group, made, False))
        return node(e)

    items = []
    for x in g.items:
        if isinstance(x, A.Triple) and _plain(x.p):
            kind = x.p == A.Iri(A.RDF_TYPE)
            x = A.Triple(node(x.s), x.p, x.o if kind else node(x.o))
        elif isinstance(x, A.Filter):
            if outer:
                x = A.Filter(expression(x.expr))
            elif isinstance(x.expr, A.Exists):
                x = A.Filter(replace(x.expr, group=_varied(x.expr.group, made, False)))
        elif isinstance(x, A.OptionalGroup):
            x = A.OptionalGroup(_varied(x.group, made, False))
        elif isinstance(x, A.Group):
            x = _varied(x, made, False)
        elif isinstance(x, A.UnionGroup):
            x = A.UnionGroup(tuple(_varied(b, made, False) for b in x.branches))
        items.append(x)
    return A.Group(tuple(items))


def parse_shape(shape: str) -> Shape:
    """Raises SparqlError where the shape is no query."""
    text, kinds = _marked(shape)
    tree, seen = parse_select(text), set()
    _varied(tree.where, lambda k: seen.add(k) or A.Var(f"_s{k}"), True)
    return Shape(tree, kinds, frozenset(seen))


def _restored(x: object, constants: dict[int, A.Iri | A.Lit | None]) -> object:
    """The tree with the constants that stay in place of their marks."""
    k = _number_of(x)
    if k is not None:
        return constants.get(k) or x
    if isinstance(x, tuple):
        return tuple(_restored(y, constants) for y in x)
    if isinstance(x, int) and not isinstance(x, bool) and x >= _NUMBER:  # of LIMIT and OFFSET
        return int(constants[x - _NUMBER].lex)
    if isinstance(x, str) and NAMESPACE + _NAME in x:  # an excluded predicate of a path
        return constants[int(x.removeprefix(NAMESPACE + _NAME))].value
    if isinstance(x, str) and x.startswith(_NAME):  # a tagged or typed literal, or a separator
        return constants[int(x.removeprefix(_NAME))].lex
    if is_dataclass(x):
        return replace(x, **{f.name: _restored(getattr(x, f.name), constants) for f in fields(x)})
    return x


def _constant(kind: str, token: str) -> A.Iri | A.Lit:
    return A.Iri(NAMESPACE + token[1:]) if kind == "n" else A.Lit(token[1:-1]) if kind == "s" else A.Lit(token, XSD + "integer")


def named(token: Column) -> tuple[Column, Column]:
    """(class, key) of a name such as :Customer12; the key is empty where a name has no such form."""
    pattern = r"^:(.*?)([0-9][0-9x]*)$"
    key = F.regexp_extract(token, pattern, 2)
    return F.when(key == "", token).otherwise(F.regexp_extract(token, pattern, 1)), key


def signature(parts: Column, vary: Column, of_class: bool) -> Column:
    """What tells the plans of one shape apart: tokens that stay, and the class of each name that varies. ``vary`` is an array of numbers."""

    def one(token: Column, k: Column) -> Column:
        name = F.when(token.startswith(":"), named(token)[0] if of_class else F.lit(":"))
        return F.when(F.array_contains(vary, k), F.coalesce(name, F.lit(""))).otherwise(token)

    return F.transform(parts, one)


def plan(shape: Shape, signed: list[str], rows: DataFrame, graph) -> tuple[A.Select, Solution]:
    """The tree of a plan and its table of slots, from ``rows`` (case, parts) of one shape and signature."""
    columns, vars_, constants = {CASE: F.col("case").cast("long")}, {CASE: Binding(Rep("int"))}, {}
    for k, (kind, token) in enumerate(zip(shape.kinds, signed, strict=True)):
        part = F.get("parts", F.lit(k))
        if k not in shape.slots:
            constants[k] = _constant(kind, token)
        elif kind == "s":
            columns[f"_s{k}"], vars_[f"_s{k}"] = F.expr(f"substring(parts[{k}], 2, length(parts[{k}]) - 2)"), Binding(Rep("str"))
        elif kind == "i":
            columns[f"_s{k}"], vars_[f"_s{k}"] = part.cast("long"), Binding(Rep("int"))
        elif (made := graph.slot(token, part)) is not None:
            columns[f"_s{k}"], vars_[f"_s{k}"] = made[0], Binding(made[1])
        else:  # a name that no table has, whatever its key
            constants[k] = A.Iri(NAMESPACE + token.removeprefix(":"))
    tree = _restored(shape.tree, constants)
    tree = replace(tree, where=_varied(tree.where, lambda k: A.Var(f"_s{k}"), True))
    return tree, Solution(rows.select(*[c.alias(column(n)) for n, c in columns.items()]), vars_)


def value_text(c: Column, rep: Rep) -> Column:
    """A value of an answer as type and text, as plain values have it; an unbound one as none."""
    number = lambda d: F.when((F.abs(d) >= 1e-3) & (F.abs(d) < 1e16) | (d == 0), decimal_text(d.cast("string").try_cast("decimal(38,18)"))).otherwise(d.cast("string"))
    said = lambda kind, t: F.concat(F.lit(f"{kind}:"), t)
    if rep.kind == "int":
        found = said("int", c.cast("string"))
    elif rep.kind == "dbl":
        found = said("float", number(c))
    elif rep.kind == "bool":
        found = said("bool", F.initcap(c.cast("string")))
    elif rep.kind == "term":
        lex, dt = c["lex"], F.coalesce(c["dt"], F.lit(""))
        whole, real = lex.try_cast("decimal(38,0)").cast("string"), number(lex.try_cast("double"))
        truth = F.when(lex.isin("true", "1"), "bool:True").when(lex.isin("false", "0"), "bool:False")
        found = F.coalesce(F.when(dt.isin(*INTEGERS), said("int", whole)).when(dt.isin(*DOUBLES), said("float", real)).when(dt == XSD + "boolean", truth), said("str", lex))
    else:
        found = said("str", lexical(c, rep))
    return F.when(c.isNull(), "none:").otherwise(found)


def is_node(c: Column, rep: Rep) -> Column:
    return c.isNotNull() if rep.kind == "node" else F.coalesce(c["k"] <= 1, F.lit(False)) if rep.kind == "term" else F.lit(False)
