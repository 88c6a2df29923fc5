"""Relational tables seen as a graph, by a direct mapping: one node per row, one predicate per column.

Patterns that share a subject read one table once (the subject is its key), keys and foreign keys stay native
columns, and a generic triple view is only built for patterns with a variable predicate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ast as A
from ..plans.expressions import compare
from ..plans.parser import NAMESPACE, PREFIXES
from ..plans.solution import Binding, Solution, column, join, union
from ..plans.terms import Rep, constant, term, to_term
from ..scratch import materialize
from .triples import TripleStore, scan

LABEL = PREFIXES["rdfs"] + "label"
_ROW = "__row"  # the name of a row of a table without a key
_KINDS = {"string": "str", "double": "dbl", "float": "dbl", "boolean": "bool", "timestamp_ntz": "time", "timestamp": "time", "date": "time"}


@dataclass(frozen=True)
class Field:
    """A predicate's column; ``ref`` is the class that a foreign key points to."""

    col: str
    ref: str | None = None


@dataclass(frozen=True)
class Table:
    """``key``: columns that make the node's name; without one each row is a blank node, told by its place in its file."""

    name: str
    cls: str
    key: tuple[str, ...]
    fields: dict[str, Field] = field(hash=False)


def _table(name: str, cls: str, key: str, **fields: str) -> Table:
    """Fields as predicate="column" or predicate="column>Class"; ``label`` stands for rdfs:label."""
    made = {}
    for p, spec in fields.items():
        col, _, ref = spec.partition(">")
        made[LABEL if p == "label" else NAMESPACE + p] = Field(col, ref or None)
    return Table(name, cls, tuple(key.split()), made)


#: The mapping of the star schema and text tables.
TABLES = [
    _table("region", "Region", "r_regionkey", label="r_name"),
    _table("nation", "Nation", "n_nationkey", label="n_name", region="n_regionkey>Region"),
    _table("customer", "Customer", "c_custkey", label="c_name", nation="c_nationkey>Nation", balance="c_acctbal", segment="c_mktsegment"),
    _table("supplier", "Supplier", "s_suppkey", label="s_name", nation="s_nationkey>Nation", balance="s_acctbal"),
    _table("part", "Part", "p_partkey", label="p_name", brand="p_brand", partType="p_type", size="p_size", price="p_retailprice"),
    _table("orders", "Order", "o_orderkey", customer="o_custkey>Customer", status="o_orderstatus", total="o_totalprice", orderDate="o_orderdate", priority="o_orderpriority"),
    _table("lineitem", "Line", "", order="l_orderkey>Order", part="l_partkey>Part", supplier="l_suppkey>Supplier", lineNumber="l_linenumber", quantity="l_quantity", extended="l_extendedprice", discount="l_discount", tax="l_tax", returnFlag="l_returnflag", lineStatus="l_linestatus", shipDate="l_shipdate"),
    _table("events", "Event", "event_id", time="ts", user="user_id>Customer", eventType="event_type", value="value", props="props"),
    _table("documents", "Document", "doc_id", text="text", language="lang", source="source", chars="n_chars"),
    _table("labels", "Label", "doc_id", document="doc_id>Document", quality="quality", toxic="toxic"),
    _table("benchmark", "Passage", "item_id", text="text"),
    _table("pages", "Page", "page_id", url="url", html="html"),
    _table("conversations", "Turn", "conv_id turn", conversation="conv_id", turn="turn", role="role", text="text"),
]


class MappedGraph:
    def __init__(self, spark: SparkSession, sf_dir: str, tables: list[Table] = TABLES, frames: dict[str, DataFrame] | None = None):
        self.spark, self.dir, self.tables, self.frames = spark, sf_dir, tables, dict(frames or {})
        self.by_class = {t.cls: t for t in tables}
        self._triples: TripleStore | None = None

    def frame(self, t: Table) -> DataFrame:
        if t.name not in self.frames:
            self.frames[t.name] = self.spark.read.parquet(f"{self.dir}/{t.name}.parquet")
        if not t.key and _ROW not in self.frames[t.name].columns:
            self.frames[t.name] = self._numbered(self.frames[t.name])
        return self.frames[t.name]

    def _numbered(self, df: DataFrame) -> DataFrame:
        """``df`` with a name for each row that is the same in every scan, whatever it filters. Rows of Parquet
        files are named by file and place; any other frame is written once with numbers."""
        place = F.concat_ws("-", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
        try:
            return df.select("*", place.alias(_ROW))
        except AnalysisException:
            return materialize(df.withColumn(_ROW, F.monotonically_increasing_id().cast("string")))

    # Values.
    def subject(self, t: Table) -> tuple[Column, Rep]:
        if not t.key:
            return F.col(_ROW), Rep("node", f"row-{t.cls}-", True)
        if len(t.key) > 1:
            return F.concat_ws("x", *t.key), Rep("node", NAMESPACE + t.cls)
        return self._native(t, t.key[0]), Rep("node", NAMESPACE + t.cls)

    def _native(self, t: Table, col: str) -> Column:
        kind = self.frame(t).schema[col].dataType.simpleString()
        return F.col(col).cast("long") if kind in ("int", "smallint", "tinyint", "bigint") else F.col(col)

    def _field(self, t: Table, f: Field) -> tuple[Column, Rep]:
        kind = self.frame(t).schema[f.col].dataType.simpleString()
        if f.ref is not None:
            return self._native(t, f.col), Rep("node", NAMESPACE + f.ref)
        if kind.startswith("decimal"):
            return F.col(f.col), Rep("dec")
        return self._native(t, f.col), Rep(_KINDS.get(kind, "int"))

    def _key_of(self, iri: str, cls: str) -> str | None:
        m = re.fullmatch(re.escape(NAMESPACE + cls) + r"([0-9][0-9x]*)", iri)
        return m.group(1) if m else None

    by_name = True  # names of nodes are a class and a key

    def slot(self, cls: str, name: Column) -> tuple[Column, Rep] | None:
        """The keys of a column of names (such as :Customer12) of one class, in the form that keys of its table have."""
        t = self.by_class.get(cls)
        if t is None or not t.key:
            return None
        key = F.regexp_extract(name, "([0-9][0-9x]*)$", 1)
        if len(t.key) == 1:
            key = key.try_cast(self.frame(t).select(self._native(t, t.key[0])).schema[0].dataType)
        return key, Rep("node", NAMESPACE + cls)

    def _is(self, value: tuple[Column, Rep], x: A.Iri | A.Lit) -> Column:
        """Whether a native value is the constant ``x``, as a term."""
        c, rep = value
        if rep.kind == "node":
            key = self._key_of(x.value, rep.of.removeprefix(NAMESPACE)) if isinstance(x, A.Iri) and not rep.blank else None
            return F.lit(False) if key is None else c == (F.lit(key) if "x" in key else F.lit(int(key)))
        if isinstance(x, A.Iri):
            return F.lit(False)
        const, kind = constant(x)
        if kind.kind == rep.kind or rep.kind == "time" and kind.kind == "time":
            return compare("=", value, (const, kind))
        return F.lit(False)

    # Patterns.
    def bgp(self, patterns: list[A.Triple], known: dict[str, Rep]) -> Solution:
        free = [t for t in patterns if isinstance(t.p, A.Var)]
        stars: dict[object, list[A.Triple]] = {}
        for t in patterns:
            if t not in free:
                stars.setdefault(t.s, []).append(t)
        choices = {s: self._tables(s, ts) for s, ts in stars.items()}
        self._narrow(stars, choices, known)
        found = [self._star(s, stars[s], choices[s]) for s in stars]
        found += [scan(self.triples().triples, t) for t in free]
        return self._ordered(found, stars, known)

    def _ordered(self, parts: list[Solution], stars: dict, known: dict) -> Solution:
        """Constants first, then whatever is connected; a product only where nothing is."""
        rank = [0 if not isinstance(s, A.Var) else 1 if any(not isinstance(t.o, A.Var) and t.p.value != A.RDF_TYPE for t in ts) else 2 for s, ts in stars.items()]
        left = [p for _, _, p in sorted(zip([*rank, *[3] * (len(parts) - len(rank))], range(len(parts)), parts, strict=True), key=lambda x: x[:2])]
        found = left.pop(0)
        while left:
            i = next((i for i, p in enumerate(left) if set(p.vars) & set(found.vars)), 0)
            found = join(found, left.pop(i))
        return found

    def _tables(self, s, ts: list[A.Triple]) -> list[Table]:
        out = []
        for t in self.tables:
            if isinstance(s, A.Iri) and (not t.key or self._key_of(s.value, t.cls) is None) or isinstance(s, A.Lit):
                continue
            if all(x.p.value in t.fields or x.p.value == A.RDF_TYPE and (isinstance(x.o, A.Var) or x.o == A.Iri(NAMESPACE + t.cls)) for x in ts):
                out.append(t)
        return out

    def _narrow(self, stars: dict, choices: dict, known: dict[str, Rep]) -> None:
        """A foreign key tells the class of what it points to, in both directions, until nothing changes."""
        classes: dict[str, set[str]] = {n: {r.of.removeprefix(NAMESPACE)} for n, r in known.items() if r.kind == "node" and not r.blank}
        changed = True
        while changed:
            changed = False
            for s, ts in stars.items():
                keep = []
                for t in choices[s]:
                    fine = not (isinstance(s, A.Var) and s.name in classes and t.cls not in classes[s.name])
                    for x in ts:
                        f = t.fields.get(x.p.value)
                        if f is not None and isinstance(x.o, A.Var) and (x.o in stars or x.o.name in classes):
                            ok = {c.cls for c in choices[x.o]} if x.o in stars else classes[x.o.name]
                            fine &= f.ref is not None and f.ref in ok
                    if fine:
                        keep.append(t)
                if len(keep) < len(choices[s]):
                    choices[s], changed = keep, True
                for x in ts:
                    refs = {t.fields[x.p.value].ref for t in keep if x.p.value in t.fields}
                    if isinstance(x.o, A.Var) and x.o in stars and x.p.value != A.RDF_TYPE:
                        less = [t for t in choices[x.o] if t.cls in refs]
                        if len(less) < len(choices[x.o]):
                            choices[x.o], changed = less, True

    def _star(self, s, ts: list[A.Triple], tables: list[Table]) -> Solution:
        if not tables:
            names = dict.fromkeys(x.name for t in ts for x in (t.s, t.o) if isinstance(x, A.Var))
            return Solution(self.spark.range(0).select(*[F.lit(None).cast("string").alias(column(n)) for n in names]), {n: Binding(Rep("str")) for n in names}, True)
        parts = [self._scan(s, ts, t) for t in tables]
        return parts[0] if len(parts) == 1 else union(parts)

    def _scan(self, s, ts: list[A.Triple], t: Table) -> Solution:
        df, out = self.frame(t), {}
        if isinstance(s, A.Var):
            out[s.name] = self.subject(t)
        else:
            df = df.where(self._is(self.subject(t), s))
        for x in ts:
            if x.p.value == A.RDF_TYPE:
                value = term(0, F.lit(NAMESPACE + t.cls)), Rep("term")
                if not isinstance(x.o, A.Var):
                    continue
            else:
                f = t.fields[x.p.value]
                value = self._field(t, f)
                df = df.where(F.col(f.col).isNotNull())
            if not isinstance(x.o, A.Var):
                df = df.where(self._is(value, x.o))
            elif x.o.name in out:
                a, b = out[x.o.name], value
                df = df.where(a[0] == b[0] if a[1] == b[1] else to_term(*a) == to_term(*b))
            else:
                out[x.o.name] = value
        if not out:
            return Solution(df.select(F.lit(1).alias("one")).select(), {})
        return Solution(df.select(*[c.alias(column(n)) for n, (c, _) in out.items()]), {n: Binding(r) for n, (_, r) in out.items()})

    # The generic view.
    def triples(self, tables: list[Table] | None = None) -> TripleStore:
        """All triples as a union of one projection per predicate: a filter on p leaves only its branches."""
        if tables is None and self._triples is not None:
            return self._triples
        out = None
        for t in self.tables if tables is None else tables:
            df, s = self.frame(t), to_term(*self.subject(t))
            branches = [df.select(s.alias("s"), F.lit(A.RDF_TYPE).alias("p"), term(0, F.lit(NAMESPACE + t.cls)).alias("o"))]
            for p, f in t.fields.items():
                branches.append(df.where(F.col(f.col).isNotNull()).select(s.alias("s"), F.lit(p).alias("p"), to_term(*self._field(t, f)).alias("o")))
            for b in branches:
                out = b if out is None else out.union(b)
        made = TripleStore(out)
        if tables is None:
            self._triples = made
        return made

    def nodes(self) -> DataFrame:
        return self.triples().nodes()

