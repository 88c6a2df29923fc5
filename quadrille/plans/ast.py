"""Syntax tree of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    lex: str
    dt: str = XSD + "string"
    lang: str | None = None


@dataclass(frozen=True)
class Var:
    name: str


# Paths; a plain Iri or Var is one too.
@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    """``path`` at least ``least`` times (0 or 1), and at most once unless ``many``."""

    path: object
    least: int
    many: bool


@dataclass(frozen=True)
class Negated:
    forward: tuple[str, ...]
    backward: tuple[str, ...]


@dataclass(frozen=True)
class Triple:
    s: object
    p: object
    o: object


@dataclass(frozen=True)
class Filter:
    expr: object


@dataclass(frozen=True)
class OptionalGroup:
    group: Group


@dataclass(frozen=True)
class UnionGroup:
    branches: tuple


@dataclass(frozen=True)
class MinusGroup:
    group: Group


@dataclass(frozen=True)
class Bind:
    expr: object
    name: str


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple


@dataclass(frozen=True)
class Group:
    items: tuple


# Expressions; Var, Iri and Lit are expressions too.
@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Exists:
    group: Group
    negated: bool


@dataclass(frozen=True)
class Aggregate:
    name: str
    arg: object | None
    distinct: bool = False
    separator: str = " "


@dataclass(frozen=True)
class Select:
    items: tuple  # (expr, name)
    where: Group
    distinct: bool = False
    group_by: tuple = ()  # (expr, name or None)
    having: tuple = ()
    order_by: tuple = ()  # (expr, descending)
    limit: int | None = None
    offset: int = 0
    values: Values | None = field(default=None)
