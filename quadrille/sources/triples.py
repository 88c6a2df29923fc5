"""A graph of generic triples: DataFrame (s: term, p: string, o: term), a set of distinct rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import ast as A
from ..plans.parser import NAMESPACE
from ..plans.solution import Binding, Solution, column, join
from ..plans.terms import TERM, TERM_REP, Rep, term

SCHEMA = f"s {TERM}, p string, o {TERM}"


def scan(triples: DataFrame, t: A.Triple) -> Solution:
    """The solutions of one pattern. A constant predicate is a filter on the partition column."""
    df, seen, out = triples, {}, []
    for part, x in (("p", t.p), ("s", t.s), ("o", t.o)):
        c = F.col(part)
        if isinstance(x, A.Iri) and part == "p":
            df = df.where(c == x.value)
        elif isinstance(x, A.Iri | A.Lit):
            want = _stored(x)
            df = df.where((F.col(f"{part}.k") == want[0]) & (F.col(f"{part}.lex") == want[1]) & (c == want[2]))
        else:
            value = c if part != "p" else term(0, c)
            if x.name in seen:
                df = df.where(value == seen[x.name])
            else:
                seen[x.name] = value
                out.append(value.alias(column(x.name)))
    df = df.select(*out) if out else df.select(F.lit(1).alias("__one")).select()
    return Solution(df, {n: Binding(TERM_REP) for n in seen})


def _stored(x: A.Iri | A.Lit):
    if isinstance(x, A.Iri):
        return 0, x.value, term(0, F.lit(x.value))
    return 2, x.lex, term(2, F.lit(x.lex), F.lit(x.dt), F.lit(x.lang))


class TripleStore:
    """Triples read from Parquet (partitioned by predicate) or any DataFrame of that schema."""

    by_name = False

    def __init__(self, triples: DataFrame):
        self.triples, self.spark = triples, triples.sparkSession

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TripleStore:
        return cls(spark.read.parquet(path).select("s", "p", "o"))

    def save(self, path: str) -> None:
        """One file per predicate and task: rows are dealt by predicate and a hash of the subject, so one
        frequent predicate is written by many tasks."""
        self.triples.repartition("p", F.pmod(F.xxhash64("s"), F.lit(16))).write.partitionBy("p").parquet(path)

    def slot(self, cls: str, name: Column) -> tuple[Column, Rep]:
        """The nodes of a column of names of the graph's own namespace."""
        return term(0, F.concat(F.lit(NAMESPACE), F.substr(name, F.lit(2)))), TERM_REP

    def bgp(self, patterns: list[A.Triple], known: dict) -> Solution:
        """Joined in an order that starts with the most constants and stays connected where it can."""
        left = sorted(patterns, key=lambda t: -sum(not isinstance(x, A.Var) for x in (t.s, t.p, t.o)))
        found: Solution | None = None
        while left:
            bound = set(found.vars) if found else set(known)
            best = next((t for t in left if any(isinstance(x, A.Var) and x.name in bound for x in (t.s, t.p, t.o))), left[0])
            left.remove(best)
            step = scan(self.triples, best)
            found = step if found is None else join(found, step)
        return found

    def nodes(self) -> DataFrame:
        """(t): every subject and object once."""
        return self.triples.select(F.col("s").alias("t")).union(self.triples.select(F.col("o").alias("t"))).distinct()

    # Access primitives.
    def objects(self, s: A.Iri, p: str) -> DataFrame:
        return self._where(s, p, None).select("o")

    def subjects(self, p: str, o: A.Iri | A.Lit) -> DataFrame:
        return self._where(None, p, o).select("s").distinct()

    def predicate_objects(self, s: A.Iri) -> DataFrame:
        return self._where(s, None, None).select("p", "o")

    def subject_objects(self, p: str) -> DataFrame:
        return self._where(None, p, None).select("s", "o")

    def contains(self, s: A.Iri, p: str, o: A.Iri | A.Lit) -> bool:
        return not self._where(s, p, o).isEmpty()

    def any_object(self, s: A.Iri, p: str):
        return self.objects(s, p).agg(F.min("o")).first()[0]

    def with_outgoing(self, nodes: DataFrame, node: str = "t") -> DataFrame:
        """The rows of ``nodes`` whose node is the subject of a triple."""
        return nodes.join(self.triples.select(F.col("s").alias(node)).distinct(), node, "left_semi")

    def size(self) -> int:
        return self.triples.distinct().count()

    def _where(self, s, p, o) -> DataFrame:
        df = self.triples
        if p is not None:
            df = df.where(F.col("p") == p)
        for part, x in (("s", s), ("o", o)):
            if x is not None:
                df = df.where(F.col(part) == _stored(x)[2])
        return df

