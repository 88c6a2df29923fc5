"""Solutions: a DataFrame with one column per variable, and what each column holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import unify
from .terms import TERM_REP, Rep, to_term


@dataclass(frozen=True)
class Binding:
    rep: Rep
    nullable: bool = False


def column(name: str) -> str:
    return f"v_{name}"


@dataclass
class Solution:
    df: DataFrame
    vars: dict[str, Binding]
    small: bool = False  # written out in the query text, so of bounded size

    def value(self, name: str):
        return (F.col(column(name)), self.vars[name].rep) if name in self.vars else None

    def select(self, names: list[str]) -> Solution:
        return Solution(self.df.select(*[column(n) for n in names]), {n: self.vars[n] for n in names}, self.small)

    def where(self, condition: Column) -> Solution:
        return Solution(self.df.where(condition), self.vars, self.small)

    def as_terms(self) -> Solution:
        return Solution(self.df.select(*[to_term(F.col(column(n)), b.rep).alias(column(n)) for n, b in self.vars.items()]), {n: Binding(TERM_REP, b.nullable) for n, b in self.vars.items()}, self.small)


def _renamed(b: Solution) -> DataFrame:
    return b.df.select(*[F.col(column(n)).alias(f"r_{n}") for n in b.vars])


def matching(a: Solution, b: Solution, skip: frozenset[str] = frozenset()) -> tuple[DataFrame, list[str], Column | None]:
    """b's columns renamed r_<name>, the shared names, and the compatibility condition but for ``skip``: unbound fits anything."""
    shared = [n for n in b.vars if n in a.vars]
    condition = None
    for n in shared:
        if n in skip:
            continue
        x, y, _ = unify((F.col(column(n)), a.vars[n].rep), (F.col(f"r_{n}"), b.vars[n].rep))
        c = x == y
        if a.vars[n].nullable:
            c = c | F.col(column(n)).isNull()
        if b.vars[n].nullable:
            c = c | F.col(f"r_{n}").isNull()
        condition = c if condition is None else condition & c
    return _renamed(b), shared, condition


def _loose(a: Solution, b: Solution, skip: frozenset[str]) -> str | None:
    """A shared variable to split on, where each shared one may be unbound and so no condition is an equality."""
    shared = [n for n in b.vars if n in a.vars and n not in skip]
    if not shared or any(not (a.vars[n].nullable or b.vars[n].nullable) for n in shared):
        return None
    return min(shared, key=lambda n: a.vars[n].nullable + b.vars[n].nullable)


def _part(s: Solution, name: str, bound: bool) -> Solution | None:
    """The rows of ``s`` that bind ``name``, or the others; None if there can be none."""
    if not s.vars[name].nullable:
        return s if bound else None
    c = F.col(column(name))
    return Solution(s.df.where(c.isNotNull() if bound else c.isNull()), s.vars | {name: Binding(s.vars[name].rep, not bound)}, s.small)


def _parts(a: Solution, b: Solution, name: str, skip: frozenset[str]) -> list[tuple[Solution, Solution, frozenset[str]]]:
    """Pairs of parts that hold every compatible pair of rows once: bound with bound, then what one or both leave unbound."""
    more = skip | {name}
    pairs = [(_part(a, name, True), _part(b, name, True), skip), (_part(a, name, True), _part(b, name, False), more), (_part(a, name, False), b, more)]
    return [(x, y, z) for x, y, z in pairs if x is not None and y is not None]


def _merged(a: Solution, b: Solution, df: DataFrame, outer: bool) -> Solution:
    cols, vars_ = [], {}
    for n in [*a.vars, *[n for n in b.vars if n not in a.vars]]:
        if n in a.vars and n in b.vars:
            x, y, rep = unify((F.col(column(n)), a.vars[n].rep), (F.col(f"r_{n}"), b.vars[n].rep))
            both = a.vars[n].nullable and (b.vars[n].nullable or outer)
            cols.append((F.coalesce(x, y) if a.vars[n].nullable else x).alias(column(n)))
            vars_[n] = Binding(rep, both)
        elif n in a.vars:
            cols.append(F.col(column(n)))
            vars_[n] = a.vars[n]
        else:
            cols.append(F.col(f"r_{n}").alias(column(n)))
            vars_[n] = Binding(b.vars[n].rep, b.vars[n].nullable or outer)
    return Solution(df.select(*cols), vars_, a.small and b.small)


def _like(s: Solution, vars_: dict[str, Binding], small: bool) -> Solution:
    return Solution(s.df.select(*[column(n) for n in vars_]), vars_, small)


def _together(parts: list[Solution], vars_: dict[str, Binding], small: bool) -> Solution:
    out = parts[0].df.select(*[column(n) for n in vars_])
    for p in parts[1:]:
        out = out.unionByName(p.df.select(*[column(n) for n in vars_]))
    return Solution(out, vars_, small)


def _shape(a: Solution, b: Solution, outer: bool) -> dict[str, Binding]:
    """The variables of a join of the two, as one that isn't split has them."""
    vars_ = {}
    for n in [*a.vars, *[n for n in b.vars if n not in a.vars]]:
        if n in a.vars and n in b.vars:
            vars_[n] = Binding(unify((F.lit(None), a.vars[n].rep), (F.lit(None), b.vars[n].rep))[2], a.vars[n].nullable and (b.vars[n].nullable or outer))
        else:
            vars_[n] = a.vars[n] if n in a.vars else Binding(b.vars[n].rep, b.vars[n].nullable or outer)
    return vars_


def join(a: Solution, b: Solution, skip: frozenset[str] = frozenset()) -> Solution:
    if a.small and not b.small:
        a, b = b, a
    name = _loose(a, b, skip)
    if name is not None:
        return _together([join(x, y, z) for x, y, z in _parts(a, b, name, skip)], _shape(a, b, False), a.small and b.small)
    right, _, condition = matching(a, b, skip)
    if b.small:
        right = F.broadcast(right)
    return _merged(a, b, a.df.crossJoin(right) if condition is None else a.df.join(right, condition, "inner"), False)


def _joined(a: Solution, b: Solution, extra: Column | None, skip: frozenset[str], how: str) -> DataFrame:
    right, _, condition = matching(a, b, skip)
    if extra is not None:
        condition = extra if condition is None else condition & extra
    return a.df.join(right, F.lit(True) if condition is None else condition, how)


def left_join(a: Solution, b: Solution, extra: Column | None) -> Solution:
    """``extra`` may name columns of both sides: v_<name> of ``a``, r_<name> of ``b``."""
    none = frozenset()
    name = _loose(a, b, none)
    if name is None:
        return _merged(a, b, _joined(a, b, extra, none, "left"), True)
    if not b.vars[name].nullable:  # each row of a is in one part
        parts = [left_join(_part(a, name, True), b, extra), _merged(a, b, _joined(_part(a, name, False), b, extra, none | {name}, "left"), True)]
    else:
        parts = [_merged(x, y, _joined(x, y, extra, z, "inner"), True) for x, y, z in _parts(a, b, name, none)]
        alone = semi_join(a, b, extra, True)
        parts.append(_merged(alone, b, alone.df.join(_renamed(b), F.lit(False), "left"), True))
    return _together(parts, _shape(a, b, True), a.small and b.small)


def semi_join(a: Solution, b: Solution, extra: Column | None, negated: bool, skip: frozenset[str] = frozenset()) -> Solution:
    name = _loose(a, b, skip)
    if name is None:
        return Solution(_joined(a, b, extra, skip, "left_anti" if negated else "left_semi"), a.vars, a.small)
    bound, unbound, theirs, loose = _part(a, name, True), _part(a, name, False), _part(b, name, True), _part(b, name, False)
    more = skip | {name}
    without = semi_join(bound, theirs, extra, True, skip)
    parts = [] if negated else [semi_join(bound, theirs, extra, False, skip)]
    if loose is not None:
        parts.append(semi_join(_like(without, bound.vars, a.small), loose, extra, negated, more))
    elif negated:
        parts.append(without)
    if unbound is not None:
        parts.append(semi_join(unbound, b, extra, negated, more))
    return _together(parts, a.vars, a.small)


def minus(a: Solution, b: Solution, skip: frozenset[str] = frozenset()) -> Solution:
    """Without a shared bound variable nothing is removed."""
    shared = [n for n in b.vars if n in a.vars and n not in skip]
    if not shared:
        return a
    name = _loose(a, b, skip)
    if name is None:
        # A variable that both sides bind is among the equalities.
        return Solution(_joined(a, b, None, skip, "left_anti"), a.vars, a.small)
    bound, unbound, loose = _part(a, name, True), _part(a, name, False), _part(b, name, False)
    left = minus(bound, _part(b, name, True), skip)
    if loose is not None:
        left = minus(left, loose, skip | {name})
    parts = [left] if unbound is None else [left, minus(unbound, b, skip | {name})]
    return _together(parts, a.vars, a.small)


def union(branches: list[Solution]) -> Solution:
    names = list(dict.fromkeys(n for b in branches for n in b.vars))
    reps: dict[str, Rep] = {}
    for n in names:
        found = {b.vars[n].rep for b in branches if n in b.vars}
        reps[n] = found.pop() if len(found) == 1 else TERM_REP
    out = None
    for b in branches:
        like = {n: next(o for o in branches if n in o.vars) for n in names}
        cols = []
        for n in names:
            if n not in b.vars:
                kind = "struct<k:tinyint,lex:string,dt:string,lang:string>" if reps[n] == TERM_REP else like[n].df.schema[column(n)].dataType
                cols.append(F.lit(None).cast(kind).alias(column(n)))
            else:
                c = F.col(column(n))
                cols.append((to_term(c, b.vars[n].rep) if reps[n] == TERM_REP else c).alias(column(n)))
        df = b.df.select(*cols)
        out = df if out is None else out.unionByName(df)
    return Solution(out, {n: Binding(reps[n], any(n not in b.vars or b.vars[n].nullable for b in branches)) for n in names})
