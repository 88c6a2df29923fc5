"""Expressions of the query language as Spark columns. An error is null, so SQL's three-valued logic is SPARQL's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SparqlError
from . import ast as A
from .terms import BNODE, DECIMAL, IRI, LITERAL, NUMERIC, STRING, TERM_REP, XSD, Rep, constant, lexical, term, to_term

Value = tuple[Column, Rep]
_NUMBERS = ("int", "dec", "dbl")
BOOL, INT, DEC, DBL, STR, TIME = (Rep(k) for k in ("bool", "int", "dec", "dbl", "str", "time"))


def number(v: Value) -> Column | None:
    """``v`` as a numeric column, null where it is no number; None when it never is."""
    c, rep = v
    if rep.kind in _NUMBERS:
        return c
    if rep.kind == "term":
        return F.when((c["k"] == LITERAL) & c["dt"].isin(*NUMERIC), F.coalesce(c["lex"].try_cast(DECIMAL), c["lex"].try_cast("double").try_cast(DECIMAL)))
    return None


def string(v: Value) -> Column | None:
    """``v`` as text where it is a plain or tagged string."""
    c, rep = v
    if rep.kind == "str":
        return c
    if rep.kind == "term":
        return F.when((c["k"] == LITERAL) & (c["dt"].isin(STRING, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")), c["lex"])
    return None


def moment(v: Value) -> Column | None:
    c, rep = v
    if rep.kind == "time":
        return c
    if rep.kind == "term":
        return F.when(c["dt"].isin(XSD + "dateTime", XSD + "date"), c["lex"].try_cast("timestamp_ntz"))
    return None


def truth(v: Value) -> Column:
    """Effective boolean value."""
    c, rep = v
    if rep.kind == "bool":
        return c
    if rep.kind in _NUMBERS:
        return c != 0
    if rep.kind == "str":
        return F.length(c) > 0
    if rep.kind == "term":
        return F.when(c["dt"] == XSD + "boolean", c["lex"].isin("true", "1")).when(number(v).isNotNull(), number(v) != 0).when(string(v).isNotNull(), F.length(c["lex"]) > 0)
    return F.lit(None).cast("boolean")


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def compare(op: str, a: Value, b: Value) -> Column:
    ra, rb = a[1], b[1]
    if ra == rb and ra.kind == "node" or ra.kind == rb.kind and ra.kind in ("int", "dec", "dbl", "str", "bool", "time"):
        return _compare(op, a[0], b[0])
    tries = []
    for read in (number, string, moment):
        x, y = read(a), read(b)
        if x is not None and y is not None:
            if read is string and op in ("=", "!=") and "term" in (ra.kind, rb.kind):
                continue  # the language tag counts
            tries.append(_compare(op, x, y))
    if op in ("=", "!="):
        same = to_term(*a) == to_term(*b)
        numeric = [n.isNotNull() for n in (number(a), number(b)) if n is not None]
        # A number and another literal cannot be told equal or not: an error.
        if "term" in (ra.kind, rb.kind) or ra.kind == "node" or rb.kind == "node":
            tries.append(same if op == "=" else ~same)
        elif not numeric:
            tries.append(F.lit(op == "!="))
    return F.coalesce(*tries) if tries else F.lit(None).cast("boolean")


def _arith(op: str, a: Value, b: Value) -> Value:
    x, y = number(a), number(b)
    if x is None or y is None:
        return F.lit(None).cast("double"), DBL
    kinds = ["dec" if v[1].kind == "term" else v[1].kind for v in (a, b)]
    if "dbl" in kinds:
        x, y, rep = x.cast("double"), y.cast("double"), DBL
    elif kinds == ["int", "int"] and op != "/":
        rep = INT
    else:
        x, y, rep = x.cast(DECIMAL), y.cast(DECIMAL), DEC
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op](x, y)
    return (f.cast(DECIMAL) if rep == DEC else f), rep


def _regex(pattern: Column, flags: Column | None) -> Column:
    f = F.lit("U") if flags is None else F.concat(F.lit("U"), F.regexp_replace(flags, "[^imsx]", ""))
    return F.concat(F.lit("(?"), f, F.lit(")"), pattern)


class Scope:
    """Compiles expressions over the variables in sight. ``exists`` compiles an EXISTS found inside an expression."""

    def __init__(self, lookup: Callable[[str], Value | None], aggregates: dict[A.Aggregate, Value] | None = None, exists: Callable[[A.Exists], Column] | None = None):
        self.lookup, self.aggregates, self.exists = lookup, aggregates or {}, exists

    def value(self, e) -> Value:
        if isinstance(e, A.Var):
            return self.lookup(e.name) or (F.lit(None).cast("string"), STR)
        if isinstance(e, A.Iri | A.Lit):
            return constant(e)
        if isinstance(e, A.Aggregate):
            if e not in self.aggregates:
                raise SparqlError("invalid SPARQL: an aggregate is not allowed here")
            return self.aggregates[e]
        if isinstance(e, A.Exists):
            if self.exists is None:
                raise SparqlError("EXISTS is not supported here")
            return self.exists(e), BOOL
        if isinstance(e, A.Op):
            return self.op(e)
        return self.call(e)

    def condition(self, e) -> Column:
        return truth(self.value(e))

    def op(self, e: A.Op) -> Value:
        if e.name in ("&&", "||"):
            a, b = map(self.condition, e.args)
            return (a & b if e.name == "&&" else a | b), BOOL
        if e.name == "!":
            return ~self.condition(e.args[0]), BOOL
        vs = [self.value(a) for a in e.args]
        if e.name == "neg":
            return _arith("-", (F.lit(0).cast("long"), INT), vs[0])
        if e.name in ("+", "-", "*", "/"):
            return _arith(e.name, *vs)
        if e.name in ("in", "not in"):
            hit = F.lit(False)
            for v in vs[1:]:
                hit = hit | compare("=", vs[0], v)
            return (hit if e.name == "in" else ~hit), BOOL
        return compare(e.name, *vs), BOOL

    def _strings(self, e: A.Call) -> list[Column]:
        out = []
        for a in e.args:
            s = string(self.value(a))
            out.append(F.lit(None).cast("string") if s is None else s)
        return out

    def _like(self, source: Value, text: Column) -> Value:
        """A string made from ``source`` keeps its language tag."""
        if source[1].kind == "term":
            c = source[0]
            return term(LITERAL, text, c["dt"], c["lang"]), TERM_REP
        return text, STR

    def call(self, e: A.Call) -> Value:
        name, args = e.name, e.args
        known = {"IF": 3, "STR": 1, "LANG": 1, "DATATYPE": 1, "BOUND": 1, "SAMETERM": 2, "ISIRI": 1, "ISURI": 1, "ISBLANK": 1, "ISLITERAL": 1, "ISNUMERIC": 1, "STRLEN": 1, "UCASE": 1, "LCASE": 1, "STRSTARTS": 2, "STRENDS": 2, "CONTAINS": 2, "STRBEFORE": 2, "STRAFTER": 2, "ENCODE_FOR_URI": 1, "LANGMATCHES": 2, "STRDT": 2, "STRLANG": 2, "ABS": 1, "ROUND": 1, "CEIL": 1, "FLOOR": 1, "RAND": 0, "NOW": 0, "YEAR": 1, "MONTH": 1, "DAY": 1, "HOURS": 1, "MINUTES": 1, "SECONDS": 1, "TIMEZONE": 1, "TZ": 1, "MD5": 1, "SHA1": 1, "SHA256": 1, "SHA384": 1, "SHA512": 1, "IRI": 1, "URI": 1, "UUID": 0, "STRUUID": 0}
        if name in known and len(args) != known[name]:
            raise SparqlError(f"invalid SPARQL: {name} takes {known[name]} arguments")
        if name == "BOUND":
            v = self.lookup(args[0].name) if isinstance(args[0], A.Var) else None
            return (F.lit(False) if v is None else v[0].isNotNull()), BOOL
        if name == "IF":
            test, yes, no = self.condition(args[0]), self.value(args[1]), self.value(args[2])
            yes, no, rep = unify(yes, no)
            return F.when(test, yes).when(~test, no), rep
        if name == "COALESCE":
            c, rep = self.value(args[0])
            for a in args[1:]:
                x, y, rep = unify((c, rep), self.value(a))
                c = F.coalesce(x, y)
            return c, rep
        vs = [self.value(a) for a in args]
        if name.startswith(XSD):
            return cast(vs[0], name.removeprefix(XSD))
        if name == "STR":
            return lexical(*vs[0]), STR
        if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            k = {"ISIRI": IRI, "ISURI": IRI, "ISBLANK": BNODE, "ISLITERAL": LITERAL}[name]
            return to_term(*vs[0])["k"] == k, BOOL
        if name == "ISNUMERIC":
            n = number(vs[0])
            return F.when(vs[0][0].isNotNull(), F.lit(False) if n is None else n.isNotNull()), BOOL
        if name == "SAMETERM":
            return to_term(*vs[0]) == to_term(*vs[1]), BOOL
        if name == "LANG":
            t = to_term(*vs[0])
            return F.when(t["k"] == LITERAL, F.coalesce(t["lang"], F.lit(""))), STR
        if name == "DATATYPE":
            t = to_term(*vs[0])
            return F.when(t["k"] == LITERAL, term(IRI, t["dt"])), TERM_REP
        if name in ("IRI", "URI"):
            t = to_term(*vs[0])
            return F.when(t["k"] != BNODE, term(IRI, t["lex"])), TERM_REP
        if name == "BNODE":
            return term(BNODE, F.concat(F.lit("b"), F.expr("uuid()"))), TERM_REP
        if name == "UUID":
            return term(IRI, F.concat(F.lit("urn:uuid:"), F.expr("uuid()"))), TERM_REP
        if name == "STRUUID":
            return F.expr("uuid()"), STR
        if name == "STRDT":
            return term(LITERAL, self._strings(e)[0], to_term(*vs[1])["lex"]), TERM_REP
        if name == "STRLANG":
            s = self._strings(e)
            return term(LITERAL, s[0], F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"), F.lower(s[1])), TERM_REP
        if name == "LANGMATCHES":
            tag, want = (F.lower(s) for s in self._strings(e))
            return F.when(want == "*", tag != "").otherwise((tag == want) | F.startswith(tag, F.concat(want, F.lit("-")))), BOOL
        if name in ("ABS", "ROUND", "CEIL", "FLOOR"):
            n = number(vs[0])
            if n is None:
                return F.lit(None).cast("double"), DBL
            kind = "dec" if vs[0][1].kind == "term" else vs[0][1].kind
            f = {"ABS": F.abs(n), "ROUND": F.floor(n + F.lit(0.5).cast("double" if kind == "dbl" else "decimal(2,1)")), "CEIL": F.ceil(n), "FLOOR": F.floor(n)}[name]
            return f.cast({"int": "long", "dec": DECIMAL, "dbl": "double"}[kind]), Rep(kind)
        if name == "RAND":
            return F.rand(), DBL
        if name == "NOW":
            return F.current_timestamp().cast("timestamp_ntz"), TIME
        if name in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES", "SECONDS"):
            m = moment(vs[0])
            m = F.lit(None).cast("timestamp_ntz") if m is None else m
            return {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute, "SECONDS": F.second}[name](m).cast("long"), INT
        if name in ("TZ", "TIMEZONE"):
            zone = F.regexp_extract(lexical(*vs[0]), "(Z|[+-]\\d\\d:\\d\\d)$", 1)
            if name == "TZ":
                return zone, STR
            # A duration of days and times: PT0S, or a sign with hours and minutes that are not 0.
            hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
            part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
            length = F.when((zone == "Z") | (hours + minutes == 0), "PT0S").otherwise(F.concat(F.when(F.startswith(zone, F.lit("-")), "-").otherwise(""), F.lit("PT"), part(hours, "H"), part(minutes, "M")))
            return term(LITERAL, F.when(zone != "", length), F.lit(XSD + "dayTimeDuration")), TERM_REP
        s = self._strings(e)
        if name == "STRLEN":
            return F.length(s[0]).cast("long"), INT
        if name in ("UCASE", "LCASE"):
            return self._like(vs[0], (F.upper if name == "UCASE" else F.lower)(s[0]))
        if name == "SUBSTR":
            start, length = number(vs[1]).cast("int"), number(vs[2]).cast("int") if len(vs) > 2 else F.lit(2**31 - 1)
            return self._like(vs[0], F.substr(s[0], start, length))
        if name in ("STRSTARTS", "STRENDS", "CONTAINS"):
            return {"STRSTARTS": F.startswith, "STRENDS": F.endswith, "CONTAINS": F.contains}[name](s[0], s[1]), BOOL
        if name in ("STRBEFORE", "STRAFTER"):
            at = F.position(s[1], s[0])
            part = F.substr(s[0], F.lit(1), at - 1) if name == "STRBEFORE" else F.substr(s[0], at + F.length(s[1]))
            return self._like(vs[0], F.when(at > 0, part).when(at == 0, ""))
        if name == "CONCAT":
            return F.concat(*s) if s else F.lit(""), STR
        if name == "ENCODE_FOR_URI":
            return F.replace(F.replace(F.url_encode(s[0]), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), STR
        if name == "REGEX":
            return F.rlike(s[0], _regex(s[1], s[2] if len(s) > 2 else None)), BOOL
        if name == "REPLACE":
            return self._like(vs[0], F.regexp_replace(s[0], _regex(s[1], s[3] if len(s) > 3 else None), s[2]))
        if name in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
            return {"MD5": F.md5, "SHA1": F.sha1}[name](s[0]) if name in ("MD5", "SHA1") else F.sha2(s[0], int(name[3:])), STR
        raise SparqlError(f"unknown function {name}")


def cast(v: Value, to: str) -> Value:
    text = F.trim(lexical(*v))
    text = F.when(v[0].isNotNull(), text)
    n = number(v)
    if v[1].kind == "bool":
        n = F.when(v[0], 1).when(~v[0], 0)
    if to in ("integer", "int", "long"):
        whole = F.when(F.rlike(text, F.lit("^[+-]?[0-9]+$")), text).try_cast("long")
        return (F.coalesce(whole, n.cast("double").try_cast("long")) if n is not None else whole), INT
    if to == "decimal":
        return (text.try_cast(DECIMAL) if n is None else F.coalesce(n.cast("string").try_cast(DECIMAL), text.try_cast(DECIMAL))), DEC
    if to in ("double", "float"):
        return (text.try_cast("double") if n is None else F.coalesce(n.cast("double"), text.try_cast("double"))), DBL
    if to == "string":
        return lexical(*v), STR
    if to == "boolean":
        said = F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
        return (said if n is None else F.coalesce(said, n != 0)), BOOL
    if to in ("dateTime", "date"):
        m = moment(v)
        return (text.try_cast("timestamp_ntz") if m is None else F.coalesce(m, text.try_cast("timestamp_ntz"))), TIME
    raise SparqlError(f"unknown cast xsd:{to}")


def unify(a: Value, b: Value) -> tuple[Column, Column, Rep]:
    """Both values in one representation."""
    if a[1] == b[1]:
        return a[0], b[0], a[1]
    return to_term(*a), to_term(*b), TERM_REP


def sort_keys(v: Value) -> list[Column]:
    """Ascending keys of the order of terms: unbound, blank nodes, IRIs, then literals; numbers by value."""
    c, rep = v
    if rep.kind == "term":
        return [F.when(c["k"] == BNODE, 0).when(c["k"] == IRI, 1).when(c["k"] == LITERAL, 2), number(v), F.when(c["dt"] == XSD + "boolean", c["lex"].isin("true", "1").cast("int")), c["lex"], c["lang"]]
    return [c]

