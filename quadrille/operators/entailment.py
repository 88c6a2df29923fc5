"""RDFS and a little OWL: what a graph entails, by one pass over its triples.

The rules on properties and classes are closed first, over the schema alone: for each property all that a triple of it entails, in four
kinds (a triple of another property, the same turned round, a class of its subject, a class of its object). The instance data then
meets that table once. Only where the schema says something of rdf:type itself do the new type triples, and no others, go round again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ast import RDF_TYPE
from ..plans.parser import PREFIXES
from ..plans.reach import reachable
from ..plans.terms import term
from ..scratch import materialize
from .skew import spread_join

RDFS, OWL = PREFIXES["rdfs"], "http://www.w3.org/2002/07/owl#"


def transitive(edges: DataFrame) -> DataFrame:
    """Closure of (x, y). Safe for cycles."""
    return reachable(edges, edges)


def effects(triples: DataFrame) -> DataFrame:
    """(p, kind, value, nodes): what a triple of property p entails by the schema in ``triples``; ``nodes`` where its object must be no literal.

    Kinds: along (value is a property), turned (a property, subject and object change places), subject and object (a class).
    Properties are closed with a sign, so that two turns are none; on the way over a turn the object becomes a subject.
    """
    schema = lambda p: triples.where(F.col("p") == p).select(F.col("s.lex").alias("x"), F.col("o.lex").alias("y"))
    signed = lambda df, a, b: df.select(F.concat(F.lit(a), "x").alias("x"), F.concat(F.lit(b), "y").alias("y"))
    up, turn = schema(RDFS + "subPropertyOf"), schema(OWL + "inverseOf")
    turn = turn.union(turn.select("y", "x"))
    edges = reduce(DataFrame.union, [signed(up, "+", "+"), signed(up, "-", "-"), signed(turn, "+", "-"), signed(turn, "-", "+")])
    asserted = F.col("x").startswith("+")
    far = reachable(edges.where(asserted), edges).where(asserted)
    plain = transitive(up).select(F.col("x").alias("p"), F.col("y").alias("q"), F.lit("+").alias("sign"), F.lit(False).alias("nodes"))
    all_ = far.select(F.expr("substring(x, 2)").alias("p"), F.expr("substring(y, 2)").alias("q"), F.substring("y", 1, 1).alias("sign"), F.lit(True).alias("nodes"))
    known = triples.select("p").union(triples.where(F.col("p").isin(RDFS + "domain", RDFS + "range")).select("s.lex")).distinct()
    itself = known.select("p", F.col("p").alias("q"), F.lit("+").alias("sign"), F.lit(False).alias("nodes"))
    reach = materialize(plain.union(all_).union(itself).groupBy("p", "q", "sign").agg(F.min("nodes").alias("nodes")))
    above = transitive(schema(RDFS + "subClassOf")).select(F.col("x").alias("c"), F.col("y").alias("value"))
    made = [reach.where("p <> q OR sign = '-'").select("p", F.when(F.col("sign") == "+", "along").otherwise("turned").alias("kind"), F.col("q").alias("value"), "nodes")]
    for rule, with_plus, with_minus in (("domain", "subject", "object"), ("range", "object", "subject")):
        said = reach.join(schema(RDFS + rule), F.col("q") == F.col("x")).select("p", F.when(F.col("sign") == "+", with_plus).otherwise(with_minus).alias("kind"), F.col("y").alias("value"), "nodes", "sign")
        # A class of the object, and one that a turn gives, need an object that is a node.
        said = said.select("p", "kind", "value", (F.col("nodes") | (F.col("sign") == "-") | (F.col("kind") == "object")).alias("nodes"))
        made += [said, said.withColumnRenamed("value", "c").join(above, "c").select("p", "kind", "value", "nodes")]
    return materialize(reduce(DataFrame.union, made).groupBy("p", "kind", "value").agg(F.min("nodes").alias("nodes")))


def rdfs_closure(triples: DataFrame) -> DataFrame:
    """``triples`` with what subClassOf, subPropertyOf, inverseOf, domain and range entail, as a set.

    A property or a class may hold most triples; the schema is small beside them. An empty graph entails nothing.
    """
    triples = materialize(triples.distinct())
    rules = effects(triples)
    schema = lambda p: triples.where(F.col("p") == p).select(F.col("s.lex").alias("x"), F.col("o.lex").alias("y"))
    classes, properties = materialize(transitive(schema(RDFS + "subClassOf"))), materialize(transitive(schema(RDFS + "subPropertyOf")))
    again = not rules.where(F.col("p") == RDF_TYPE).isEmpty()
    found, new = [triples], triples
    typed = lambda c: term(0, F.when(F.col("kind").isin("subject", "object"), c))
    while True:
        spread = F.xxhash64("s", "o")
        met = spread_join(new, rules, ["p"], spread, "inner").where(~F.col("nodes") | (F.col("o.k") < 2))
        turned = F.col("kind").isin("turned", "object")
        derived = met.select(
            F.when(turned, F.col("o")).otherwise(F.col("s")).alias("s"), F.when(F.col("kind").isin("along", "turned"), F.col("value")).otherwise(RDF_TYPE).alias("p"),
            F.when(F.col("kind") == "along", F.col("o")).when(F.col("kind") == "turned", F.col("s")).otherwise(typed(F.col("value"))).alias("o"),
        )
        derived = materialize(derived)
        told = new.unionByName(derived).where((F.col("p") == RDF_TYPE) & (F.col("o.k") < 2)).withColumn("x", F.col("o.lex"))
        higher = spread_join(materialize(told), classes, ["x"], F.xxhash64("s"), "inner").select("s", "p", term(0, F.col("y")).alias("o"))
        new = materialize(derived.unionByName(higher).distinct().join(reduce(DataFrame.union, found), ["s", "p", "o"], "left_anti"))
        found.append(new)
        new = new.where(F.col("p") == RDF_TYPE)
        if not again or new.isEmpty():
            break
    # All that was found is disjoint by now; only the closed schema may repeat what was said of it.
    every = reduce(DataFrame.unionByName, found)
    pairs = [df.select(term(0, F.col("x")).alias("s"), F.lit(p).alias("p"), term(0, F.col("y")).alias("o")) for p, df in ((RDFS + "subClassOf", classes), (RDFS + "subPropertyOf", properties))]
    said = every.where(F.col("p").isin(RDFS + "subClassOf", RDFS + "subPropertyOf"))
    return every.unionByName(reduce(DataFrame.unionByName, pairs).distinct().join(said, ["s", "p", "o"], "left_anti"))
