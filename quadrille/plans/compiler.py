"""From the syntax tree to DataFrames: group patterns, paths, aggregation and solution modifiers."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SparqlError
from . import ast as A
from .expressions import DEC, INT, STR, Scope, Value, number, sort_keys
from .reach import reachable
from .solution import Binding, Solution, column, join, left_join, matching, minus, semi_join, union
from .terms import DECIMAL, TERM_REP, Rep, constant, lexical, to_term


@dataclass
class Answer:
    """A compiled query: its DataFrame has one column v_<name> per answer column, in order."""

    df: DataFrame
    names: list[str]
    reps: dict[str, Rep]

    def frame(self) -> DataFrame:
        """The answer as plain columns: decimals as text, times in ISO form, graph nodes refused."""
        cols = []
        for n in self.names:
            c, rep = F.col(column(n)), self.reps[n]
            if rep.kind == "node":
                raise SparqlError(f"answer column ?{n} holds a graph node: select a label or another literal")
            if rep.kind == "term":
                c = F.when(c["k"] <= 1, F.raise_error(F.lit(f"answer column ?{n} holds a graph node: select a label or another literal"))).otherwise(c["lex"])
            elif rep.kind in ("dec", "time"):
                c = lexical(c, rep)
            cols.append(c.alias(n))
        return self.df.select(*cols)


def _conjuncts(e) -> list:
    return [x for a in e.args for x in _conjuncts(a)] if isinstance(e, A.Op) and e.name == "&&" else [e]


def variables(e) -> set[str]:
    """Variables an expression reads, without those inside EXISTS."""
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, A.Op | A.Call):
        return set().union(*map(variables, e.args)) if e.args else set()
    if isinstance(e, A.Aggregate):
        return variables(e.arg) if e.arg is not None else set()
    return set()


def _aggregates(e) -> list[A.Aggregate]:
    if isinstance(e, A.Aggregate):
        return [e]
    return [x for a in e.args for x in _aggregates(a)] if isinstance(e, A.Op | A.Call) else []


class Compiler:
    def __init__(self, spark: SparkSession, graph):
        self.spark, self.graph, self.fresh = spark, graph, itertools.count()

    # Queries.
    def select(self, q: A.Select, given: Solution | None = None, case: str = "") -> Answer:
        """With ``given``, a table that binds variables of the outer group, the answers of all its rows at once: grouping, order and
        limits then hold within each value of its variable ``case``, which is the last column of the answer."""
        if given is not None:
            q = replace(q, items=(*q.items, (A.Var(case), case)))
        found, _ = self.group(q.where, given=given)
        if q.values is not None:
            found = self._and(found, self.values(q.values))
        found = self._unit() if found is None else found
        calls = [x for e, _ in q.items for x in _aggregates(e)] + [x for e in q.having for x in _aggregates(e)] + [x for e, _ in q.order_by for x in _aggregates(e)]
        if q.group_by or calls or q.having:
            if given is None:
                found, aggregates = self.aggregate(found, q, list(dict.fromkeys(calls)))
            else:
                found, aggregates = self._aggregate_cases(found, q, list(dict.fromkeys(calls)), given, case)
        else:
            aggregates = {}
        made: dict[str, Value] = {}
        scope = Scope(lambda n: made.get(n) or found.value(n), aggregates)
        for e in q.having:
            found = found.where(scope.condition(e))
        reps: dict[str, Rep] = {}
        df = found.df
        for e, name in q.items:
            grouped = (q.group_by or calls) and isinstance(e, A.Var) and name not in found.vars
            if grouped and name not in made:
                raise SparqlError(f"?{name} is neither grouped nor aggregated")
            c, rep = scope.value(e)
            df = df.withColumn(f"o_{name}", c)
            reps[name] = rep
            if not isinstance(e, A.Var):
                made[name] = (F.col(f"o_{name}"), rep)
        keys = []
        for e, descending in q.order_by:
            for c in sort_keys(scope.value(e)):
                k = f"k_{len(keys)}"
                df = df.withColumn(k, c)
                keys.append(F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_first())
        names = [n for _, n in q.items]
        out = [F.col(f"o_{n}").alias(column(n)) for n in names]
        if q.distinct:
            sort = [f"k_{i}" for i in range(len(keys))]
            df = df.select(*out, *sort).distinct() if not sort else df.select(*out, *sort).groupBy(*[column(n) for n in names]).agg(*[F.min(k).alias(k) for k in sort])
            out = [F.col(column(n)) for n in names]
        if given is not None:
            if q.offset or q.limit is not None:
                w = Window.partitionBy(column(case) if q.distinct else f"o_{case}").orderBy(*(keys or out))
                last = q.offset + q.limit if q.limit is not None else None
                df = df.withColumn("k_row", F.row_number().over(w)).where((F.col("k_row") > q.offset) & (F.lit(True) if last is None else F.col("k_row") <= last))
            return Answer(df.select(*out), names, reps)
        if keys:
            df = df.orderBy(*keys)
        df = df.select(*out)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Answer(df, names, reps)

    def _aggregate_cases(self, found: Solution, q: A.Select, calls: list[A.Aggregate], given: Solution, case: str) -> tuple[Solution, dict[A.Aggregate, Value]]:
        """Aggregates within each case. Without a grouping key a case that has no solution has one row, that of no solutions."""
        made, reps = self.aggregate(found, replace(q, group_by=(*q.group_by, (A.Var(case), None))), calls)
        if not q.group_by:
            none, _ = self.aggregate(found.where(F.lit(False)), q, calls)
            missing = given.df.select(column(case)).join(made.df.select(column(case)), column(case), "left_anti")
            made = Solution(made.df.unionByName(missing.join(F.broadcast(none.df)).select(*made.df.columns)), made.vars)
        return made, reps

    def aggregate(self, found: Solution, q: A.Select, calls: list[A.Aggregate]) -> tuple[Solution, dict[A.Aggregate, Value]]:
        scope = Scope(found.value)
        df, keys, vars_ = found.df, [], {}
        for i, (e, name) in enumerate(q.group_by):
            c, rep = scope.value(e)
            key = name or (e.name if isinstance(e, A.Var) else f"_g{i}")
            df = df.withColumn(column(key), c)
            keys.append(column(key))
            vars_[key] = Binding(rep, True)
        plain, distinct_args, reps = [], [], {}
        for i, a in enumerate(calls):
            v = None if a.arg is None else scope.value(a.arg)
            c, rep = self._aggregate(a, v)
            plain.append(c.alias(f"a_{i}"))
            reps[a] = (F.col(f"a_{i}"), rep)
        if not plain:
            plain.append(F.count(F.lit(1)).alias("a_none"))
        df = df.groupBy(*keys).agg(*plain) if keys else df.agg(*plain)
        return Solution(df, vars_), reps

    def _aggregate(self, a: A.Aggregate, v: Value | None) -> Value:
        if a.name == "COUNT":
            if v is None:
                return (F.count_distinct(F.struct("*")) if a.distinct else F.count(F.lit(1))), INT
            return (F.count_distinct(v[0]) if a.distinct else F.count(v[0])), INT
        c, rep = v
        if a.name in ("SUM", "AVG"):
            n = number(v)
            if n is None:
                return F.max(F.lit(None).cast("double")), Rep("dbl")
            # A bound value that is no number makes the whole aggregate an error.
            fine = F.lit(True) if rep.kind != "term" else ~F.max(c.isNotNull() & n.isNull())
            kind = "dec" if rep.kind == "term" else rep.kind
            if a.name == "SUM":
                total = F.coalesce((F.sum_distinct if a.distinct else F.sum)(n), F.lit(0))
                total = total.cast(DECIMAL) if kind == "dec" else total
                return F.when(F.coalesce(fine, F.lit(True)), total), Rep(kind)
            if kind == "dbl":
                mean = F.coalesce((F.avg(n) if not a.distinct else F.try_divide(F.sum_distinct(n), F.count_distinct(n))), F.lit(0.0))
                return F.when(F.coalesce(fine, F.lit(True)), mean), Rep("dbl")
            n = n.cast(DECIMAL)
            mean = F.coalesce(F.try_divide((F.sum_distinct if a.distinct else F.sum)(n), (F.count_distinct if a.distinct else F.count)(n)).cast(DECIMAL), F.lit(0).cast(DECIMAL))
            return F.when(F.coalesce(fine, F.lit(True)), mean), DEC
        if a.name in ("MIN", "MAX"):
            if rep.kind != "term":
                return (F.min if a.name == "MIN" else F.max)(c), rep
            keyed = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(v))], c.alias("t"))
            return (F.min if a.name == "MIN" else F.max)(F.when(c.isNotNull(), keyed))["t"], rep
        if a.name == "SAMPLE":
            return F.min(c), rep
        text = lexical(c, rep)
        got = F.collect_set(text) if a.distinct else F.collect_list(text)
        return F.array_join(F.array_sort(got), a.separator), STR

    # Groups.
    def _unit(self) -> Solution:
        return Solution(self.spark.range(1).select(), {}, True)

    def _and(self, a: Solution | None, b: Solution) -> Solution:
        return b if a is None else join(a, b)

    def group(self, g: A.Group, outer: dict[str, Rep] | None = None, given: Solution | None = None) -> tuple[Solution | None, list]:
        """The solutions, and the filters that read variables of the group outside. ``given`` solutions are joined first."""
        found = given
        filters, late, triples = [], [], []

        def flush() -> None:
            nonlocal found
            if triples:
                known = dict(outer or {}) | ({n: b.rep for n, b in found.vars.items()} if found else {})
                found = self._and(found, self.bgp(list(triples), known))
                triples.clear()

        for item in g.items:
            if isinstance(item, A.Triple):
                triples.append(item)
                continue
            if isinstance(item, A.Filter):
                filters += _conjuncts(item.expr)
                continue
            flush()
            if isinstance(item, A.Select):
                sub = self.select(item)
                found = self._and(found, Solution(sub.df, {n: Binding(sub.reps[n], True) for n in sub.names}))
                found.vars.update({n: Binding(b.rep, b.nullable and not self._certain(item, n)) for n, b in found.vars.items() if n in sub.names})
            elif isinstance(item, A.Group):
                inner, more = self.group(item, outer)
                found = inner if found is None else found if inner is None else join(found, inner)
                late += more
            elif isinstance(item, A.UnionGroup):
                branches = []
                for b in item.branches:
                    inner, _ = self.group(b, outer)
                    branches.append(self._unit() if inner is None else inner)
                found = self._and(found, union(branches))
            elif isinstance(item, A.OptionalGroup):
                found = self.optional(found or self._unit(), item.group)
            elif isinstance(item, A.MinusGroup):
                inner, _ = self.group(item.group)
                if inner is not None and found is not None:
                    found = minus(found, inner)
            elif isinstance(item, A.Bind):
                found = self._unit() if found is None else found
                if item.name in found.vars:
                    raise SparqlError(f"invalid SPARQL: BIND to ?{item.name}, which is already in use")
                c, rep = Scope(found.value).value(item.expr)
                found = Solution(found.df.withColumn(column(item.name), c), found.vars | {item.name: Binding(rep, not self._total(item.expr, found))}, found.small)
            elif isinstance(item, A.Values):
                found = self._and(found, self.values(item))
        flush()
        for e in filters:
            if isinstance(e, A.Exists):
                found = self.exists(found or self._unit(), e)
                continue
            here = set(found.vars) if found else set()
            if outer and (variables(e) - here) & set(outer):
                late.append(e)
                continue
            found = found or self._unit()
            extra: list[tuple[A.Exists, str]] = []
            found = self._flags(found, e, extra)
            names = dict(extra)
            scope = Scope(found.value, exists=lambda x, names=names: F.col(names[x]))
            kept = found.where(scope.condition(e))
            found = Solution(kept.df.drop(*names.values()), found.vars, found.small)
        return found, late

    def _certain(self, q: A.Select, name: str) -> bool:
        """Whether a sub-query surely binds ``name``: a variable of its triples, COUNT, or what a group that has rows makes of such a variable."""
        e = next(e for e, n in q.items if n == name)
        sure = {x.name for t in q.where.items if isinstance(t, A.Triple) for x in (t.s, t.p, t.o) if isinstance(x, A.Var)}
        if isinstance(e, A.Aggregate):
            if e.name == "COUNT":
                return True
            return bool(q.group_by) and e.name in ("MIN", "MAX", "SAMPLE") and isinstance(e.arg, A.Var) and e.arg.name in sure
        return isinstance(e, A.Var) and e.name in sure

    def _total(self, e, found: Solution) -> bool:
        """Whether an expression has a value in every row: constants, bound variables, their STR, and sums of native numbers."""
        if isinstance(e, A.Var):
            return e.name in found.vars and not found.vars[e.name].nullable
        if isinstance(e, A.Lit | A.Iri):
            return True
        if isinstance(e, A.Call) and e.name == "STR":
            return all(self._total(x, found) and not (isinstance(x, A.Var) and found.vars[x.name].rep.blank) for x in e.args)
        if isinstance(e, A.Op) and e.name in ("+", "-", "*"):
            return all(isinstance(x, A.Var) and self._total(x, found) and found.vars[x.name].rep.kind in ("int", "dbl") or isinstance(x, A.Lit) and Scope(found.value).value(x)[1].kind in ("int", "dbl") for x in e.args)
        return False

    def optional(self, a: Solution, g: A.Group) -> Solution:
        inner, late = self.group(g, {n: b.rep for n, b in a.vars.items()})
        if inner is None:
            return a
        return left_join(a, inner, self._late(a, inner, late))

    def _late(self, a: Solution, inner: Solution, late: list) -> Column | None:
        """Filters of an inner group that also read outer variables, over columns v_ (outer) and r_ (inner)."""
        if not late:
            return None
        scope = Scope(lambda n: (F.col(f"r_{n}"), inner.vars[n].rep) if n in inner.vars else a.value(n))
        out = None
        for e in late:
            c = scope.condition(e)
            out = c if out is None else out & c
        return out

    def exists(self, a: Solution, e: A.Exists) -> Solution:
        inner, late = self.group(e.group, {n: b.rep for n, b in a.vars.items()})
        if inner is None:
            return a.where(F.lit(not e.negated))
        if not late:
            inner = inner.select([n for n in inner.vars if n in a.vars]) if set(inner.vars) & set(a.vars) else inner
        return semi_join(a, inner, self._late(a, inner, late), e.negated)

    def _flags(self, a: Solution, e, found: list) -> Solution:
        """A boolean column for each EXISTS inside the expression ``e``."""
        if isinstance(e, A.Exists):
            inner, late = self.group(e.group, {n: b.rep for n, b in a.vars.items()})
            name = f"e_{next(self.fresh)}"
            shared = [n for n in (inner.vars if inner else {}) if n in a.vars]
            if late or any(a.vars[n].nullable or inner.vars[n].nullable for n in shared):
                raise SparqlError("EXISTS inside an expression may not use outer filters or unbound variables")
            if not shared:
                hit = inner is None or not inner.df.isEmpty()
                df = a.df.withColumn(name, F.lit(hit != e.negated))
            else:
                right, _, condition = matching(a, Solution(inner.select(shared).df.distinct(), {n: inner.vars[n] for n in shared}))
                df = a.df.join(right.withColumn(name, F.lit(True)), condition, "left").drop(*right.columns).withColumn(name, F.coalesce(F.col(name), F.lit(False)) != e.negated)
            found.append((e, name))
            return Solution(df, a.vars, a.small)
        if isinstance(e, A.Op | A.Call):
            for x in e.args:
                a = self._flags(a, x, found)
        return a

    def values(self, v: A.Values) -> Solution:
        """An inline table; at most a few thousand rows, as the query text is bounded. UNDEF is unbound."""
        reps, rows = {}, []
        for i, n in enumerate(v.names):
            kinds = {constant(r[i])[1] for r in v.rows if r[i] is not None}
            reps[n] = kinds.pop() if len(kinds) == 1 else TERM_REP
        blank = "struct<k:tinyint,lex:string,dt:string,lang:string>"
        if not v.rows:
            return Solution(self.spark.range(0).select(*[F.lit(None).cast("string").alias(column(n)) for n in v.names]), {n: Binding(Rep("str")) for n in v.names}, True)
        for r in v.rows:
            cells = [F.lit(None).cast(blank) if x is None and reps[n] == TERM_REP else F.lit(None) if x is None else to_term(*constant(x)) if reps[n] == TERM_REP else constant(x)[0] for n, x in zip(v.names, r, strict=True)]
            rows.append(F.struct(*[c.alias(column(n)) for n, c in zip(v.names, cells, strict=True)]))
        df = self.spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        return Solution(df, {n: Binding(reps[n], any(r[i] is None for r in v.rows)) for i, n in enumerate(v.names)}, True)

    # Basic graph patterns and paths.
    def bgp(self, triples: list[A.Triple], known: dict[str, Rep]) -> Solution:
        simple, paths = [], []
        for t in triples:
            self._expand(t, simple, paths)
        # Patterns that only a path connects are joined after it, not with each other.
        groups = self._connected(simple) if paths else [simple] if simple else []
        found = self.graph.bgp(groups.pop(0), known) if groups else None
        for t in paths:
            know = known | ({n: b.rep for n, b in found.vars.items()} if found else {})
            found = self._and(found, self.path(t, know))
            for g in [g for g in groups if self._names(g) & set(found.vars)]:
                groups.remove(g)
                found = self._and(found, self.graph.bgp(g, known | {n: b.rep for n, b in found.vars.items()}))
        for g in groups:
            found = self._and(found, self.graph.bgp(g, known))
        return found

    @staticmethod
    def _names(triples: list[A.Triple]) -> set[str]:
        return {x.name for t in triples for x in (t.s, t.p, t.o) if isinstance(x, A.Var)}

    def _connected(self, triples: list[A.Triple]) -> list[list[A.Triple]]:
        """Groups of triples that share variables, directly or by others, in the order of their first triples."""
        groups: list[list[A.Triple]] = []
        for t in triples:
            near = [g for g in groups if self._names(g) & self._names([t])]
            if near:
                groups[groups.index(near[0])] = [x for g in near for x in g] + [t]
                groups = [g for g in groups if not any(g is n for n in near[1:])]
            else:
                groups.append([t])
        return groups

    def _expand(self, t: A.Triple, simple: list, paths: list) -> None:
        if isinstance(t.p, A.Sequence):
            at = t.s
            for i, p in enumerate(t.p.parts):
                to = t.o if i == len(t.p.parts) - 1 else A.Var(f"_p{next(self.fresh)}")
                self._expand(A.Triple(at, p, to), simple, paths)
                at = to
        elif isinstance(t.p, A.Inverse):
            self._expand(A.Triple(t.o, t.p.path, t.s), simple, paths)
        elif isinstance(t.p, A.Iri | A.Var):
            simple.append(t)
        else:
            paths.append(t)

    def path(self, t: A.Triple, known: dict[str, Rep]) -> Solution:
        if isinstance(t.p, A.Alternative):
            return union([self.bgp([A.Triple(t.s, p, t.o)], known) for p in t.p.parts])
        if isinstance(t.p, A.Negated):
            found = []
            for excluded, s, o in ((t.p.forward, t.s, t.o), (t.p.backward, t.o, t.s)):
                if excluded or (not t.p.backward and s is t.s):
                    v = A.Var(f"_p{next(self.fresh)}")
                    any_ = self.graph.bgp([A.Triple(s, v, o)], known)
                    lex = lexical(F.col(column(v.name)), any_.vars[v.name].rep)
                    kept = any_.where(~lex.isin(*excluded)) if excluded else any_
                    found.append(kept.select([n for n in kept.vars if n != v.name]))
            return found[0] if len(found) == 1 else union(found)
        return self._repeat(t, known)

    def _repeat(self, t: A.Triple, known: dict[str, Rep]) -> Solution:
        """Closures: pairs (x, y) by :func:`reachable`; a constant start (or end) restricts it from the first step on."""
        a, b = A.Var(f"_p{next(self.fresh)}"), A.Var(f"_p{next(self.fresh)}")
        same = isinstance(t.s, A.Var) and isinstance(t.o, A.Var)
        backwards = not isinstance(t.o, A.Var) and isinstance(t.s, A.Var)
        edges = self.bgp([A.Triple(a, t.p.path, b)], {}).select([a.name, b.name])
        if edges.vars[a.name].rep != edges.vars[b.name].rep or not same or t.p.least == 0:
            edges = edges.as_terms()
        rep = edges.vars[a.name].rep
        x, y = (b.name, a.name) if backwards else (a.name, b.name)
        e = edges.df.select(F.col(column(x)).alias("x"), F.col(column(y)).alias("y")).distinct()
        fixed = t.o if backwards else None if isinstance(t.s, A.Var) else t.s
        start = None if fixed is None else to_term(*constant(fixed))
        seen = e if start is None else e.where(F.col("x") == start)
        if t.p.many:
            seen = reachable(seen, e)
        if t.p.least == 0:
            none = self.spark.range(1).select(start.alias("x")) if start is not None else self.graph.nodes().select(F.col("t").alias("x"))
            seen = seen.union(none.select("x", F.col("x").alias("y"))).distinct()
        ends = {0: t.o if backwards else t.s, 1: t.s if backwards else t.o}
        for i, c in ((0, "x"), (1, "y")):
            if not isinstance(ends[i], A.Var):
                seen = seen.where(F.col(c) == to_term(*constant(ends[i])))
        if same and t.s == t.o:
            seen = seen.where("x = y")
        names = {ends[i].name: c for i, c in ((0, "x"), (1, "y")) if isinstance(ends[i], A.Var)}
        return Solution(seen.select(*[F.col(c).alias(column(n)) for n, c in names.items()]), {n: Binding(rep) for n in names})

