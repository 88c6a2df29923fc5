"""How the value of a variable is held in a DataFrame column.

Most columns of a mapped table keep their native Spark type, and only their description (a Rep)
says what RDF term they stand for; so joins and comparisons run on integers and strings. The general
form is a struct of kind, lexical form, datatype and language.
"""

from __future__ import annotations

import decimal
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ast import XSD, Iri, Lit

TERM = "struct<k:tinyint,lex:string,dt:string,lang:string>"
IRI, BNODE, LITERAL = 0, 1, 2
STRING = XSD + "string"
INTEGERS = tuple(XSD + t for t in ("integer", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "long", "int", "short", "byte", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte"))
DOUBLES = (XSD + "double", XSD + "float")
NUMERIC = (*INTEGERS, *DOUBLES, XSD + "decimal")
DECIMAL = "decimal(38,18)"


@dataclass(frozen=True)
class Rep:
    """``kind``: node (of class prefix ``of``), int, dec, dbl, str, bool, time or term."""

    kind: str
    of: str = ""
    blank: bool = False


TERM_REP = Rep("term")
_DT = {"int": "integer", "dec": "decimal", "dbl": "double", "str": "string", "bool": "boolean", "time": "dateTime"}


def term(k: int, lex: Column, dt: Column | None = None, lang: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    t = F.struct(F.lit(k).cast("tinyint").alias("k"), lex.cast("string").alias("lex"), (none if dt is None else dt).alias("dt"), (none if lang is None else lang).alias("lang"))
    return F.when(lex.isNotNull(), t)


def decimal_text(c: Column) -> Column:
    """Canonical text of a computed decimal: no trailing zeros, one digit after the point at least."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), "0+$", ""), "\\.$", ".0")


def lexical(c: Column, rep: Rep) -> Column:
    if rep.kind == "node":
        return F.concat(F.lit(rep.of), c.cast("string"))
    if rep.kind == "term":
        return c["lex"]
    if rep.kind == "time":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if rep.kind == "dec":
        return decimal_text(c)
    return c.cast("string")


def to_term(c: Column, rep: Rep) -> Column:
    if rep.kind == "term":
        return c
    if rep.kind == "node":
        return term(BNODE if rep.blank else IRI, lexical(c, rep))
    return term(LITERAL, lexical(c, rep), F.lit(XSD + _DT[rep.kind]))


def constant(value: Iri | Lit) -> tuple[Column, Rep]:
    """A constant of a query as a column."""
    if isinstance(value, Iri):
        return term(IRI, F.lit(value.value)), TERM_REP
    if value.lang is not None:
        return term(LITERAL, F.lit(value.lex), F.lit(value.dt), F.lit(value.lang)), TERM_REP
    try:
        if value.dt == XSD + "integer":
            n = int(value.lex)
            return (F.lit(n).cast("long"), Rep("int")) if abs(n) < 1 << 63 else (F.lit(value.lex).cast("decimal(38,0)"), Rep("dec"))
        if value.dt == XSD + "decimal":
            return F.lit(decimal.Decimal(value.lex)).cast(DECIMAL), Rep("dec")
        if value.dt == XSD + "double":
            return F.lit(float(value.lex)), Rep("dbl")
    except (ValueError, decimal.InvalidOperation):
        pass
    if value.dt == STRING:
        return F.lit(value.lex), Rep("str")
    if value.dt == XSD + "boolean" and value.lex in ("true", "false", "1", "0"):
        return F.lit(value.lex in ("true", "1")), Rep("bool")
    if value.dt in (XSD + "dateTime", XSD + "date"):
        return F.lit(value.lex).try_cast("timestamp_ntz"), Rep("time")
    return term(LITERAL, F.lit(value.lex), F.lit(value.dt)), TERM_REP
