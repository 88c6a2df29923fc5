"""Path closures over the whole table of conversations."""

import pytest

from quadrille import workloads
from quadrille.operators import entailment
from quadrille.plans import reach
from quadrille.plans.reach import reachable
from quadrille.scratch import materialize
from quadrille.sources.turtle import graph_of


def test_closure_reads_every_conversation(spark, tmp_path):
    """Beyond the first twelve conversations, and turns from 1000 on don't run into the next conversation."""
    turns = [(c, t) for c in (0, 1, 40) for t in range(3)] + [(0, 999), (0, 1000), (0, 1001), (3, 1), (3, 2), (3, 999), (4, 0)]
    spark.createDataFrame(turns, "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    every = set(turns)
    expected, star = [], []
    for c, t in turns:
        end = t
        while (c, end + 1) in every:
            end += 1
            expected.append((t, end))
        if (c, t) == (3, 1):
            star = list(range(t, end + 1))
    got = workloads.QUERIES["path_closure_plus"](spark, str(tmp_path)).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(expected)
    assert sorted(r["b"] for r in workloads.QUERIES["path_closure_star"](spark, str(tmp_path)).collect()) == star


def test_ends_of_a_closure_are_not_crossed(spark, sf_dir):
    """Patterns at both ends of a path meet by the path, not in a product of the table with itself."""
    plan = workloads.QUERIES["path_closure_plus"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _closed(edges):
    """All pairs by a search from each node."""
    out = set()
    for a in {x for x, _ in edges}:
        todo = [y for x, y in edges if x == a]
        while todo:
            y = todo.pop()
            if (a, y) not in out:
                out.add((a, y))
                todo += [z for x, z in edges if x == y]
    return out


@pytest.mark.parametrize(("steps", "growth"), [(0, 8), (2, 1)])
def test_reachability_by_jumps(spark, steps, growth):
    """Chains, cycles, a ladder of many walks and loops, whatever the number of single steps and of jumps."""
    edges = [(i, i + 1) for i in range(14)] + [(100 + i, 100 + (i + 1) % 11) for i in range(11)] + [(200 + i, 200 + j) for i in range(7) for j in range(7) if j in (i + 1, i + 2)] + [(5, 5), (12, 200), (206, 100)]
    df = spark.createDataFrame(edges, "x long, y long")
    assert {tuple(r) for r in reachable(df, df, steps, growth).collect()} == _closed(edges)
    seeds = spark.createDataFrame([(-1, 3), (-2, 105)], "x long, y long")
    got = [tuple(r) for r in reachable(seeds, df, steps, growth).collect()]
    want = {(-1, 3), (-2, 105)} | {(-1, y) for x, y in _closed(edges) if x == 3} | {(-2, y) for x, y in _closed(edges) if x == 105}
    assert set(got) == want and len(got) == len(want)


def test_a_chain_of_ten_thousand_nodes_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(reach, "materialize", lambda df: written.append(1) or materialize(df))
    edges = spark.range(10_000).selectExpr("id AS x", "id + 1 AS y")
    assert reachable(edges.where("x = 0"), edges).count() == 10_000
    assert len(written) <= 2 + 4 + 2 * 15


RULES = """@prefix : <urn:quadrille:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
:p rdfs:subPropertyOf :q . :q rdfs:subPropertyOf :r . :q owl:inverseOf :back . :back rdfs:subPropertyOf :far ; rdfs:domain :D ; rdfs:range :E . :r rdfs:domain :F ; rdfs:range :G .
:C rdfs:subClassOf :D . :D rdfs:subClassOf :H . :G rdfs:subClassOf :C . :far owl:inverseOf :near . :kind rdfs:subPropertyOf rdf:type . :loop rdfs:subPropertyOf :loop ; owl:inverseOf :loop .
:a :p :b . :a :p "literal" . :c :back :d . :e a :C . :f :kind :G . :g :r 7 . :h :loop :i . :j :other :k . :a a :Alone ."""


def _entailed(rows):
    """The rules one by one over sets of triples until nothing is new."""
    rdfs, owl, type_ = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    pairs = lambda p: {(s[1], o[1]) for s, q, o in rows if q == p}
    iri = lambda x: (0, x, None, None)
    sub, inv, dom, ran, cls = (pairs(p) for p in (rdfs + "subPropertyOf", owl + "inverseOf", rdfs + "domain", rdfs + "range", rdfs + "subClassOf"))
    inv |= {(b, a) for a, b in inv}
    all_ = set(rows)
    while True:
        new = set()
        for s, p, o in all_:
            new |= {(s, q, o) for x, q in sub if x == p} | {(s, type_, iri(c)) for x, c in dom if x == p}
            if o[0] < 2:
                new |= {(o, q, s) for x, q in inv if x == p} | {(o, type_, iri(c)) for x, c in ran if x == p}
                new |= {(s, p, iri(c)) for x, c in cls if p == type_ and x == o[1]}
            new |= {(s, p, iri(c)) for x, c in cls if p == rdfs + "subClassOf" and x == o[1]} | {(s, p, iri(c)) for x, c in sub if p == rdfs + "subPropertyOf" and x == o[1]}
        if new <= all_:
            return all_
        all_ |= new


@pytest.mark.parametrize("more", ["", "rdf:type rdfs:subPropertyOf :isa ; rdfs:domain :Thing . :isa rdfs:range :Class . :Class rdfs:subClassOf :Meta ."])
def test_entailment_against_rules_one_by_one(spark, more):
    store = graph_of(spark, RULES + more)
    rows = [(tuple(r["s"]), r["p"], tuple(r["o"])) for r in store.triples.collect()]
    got = [(tuple(r["s"]), r["p"], tuple(r["o"])) for r in entailment.rdfs_closure(store.triples).collect()]
    assert set(got) == _entailed(rows) and len(got) == len(set(got))


def test_schema_pairs_come_once_and_given_classes_climb(spark):
    """The result needs no deduplication at its end: no aggregate lies over the instance triples."""
    g = graph_of(spark, """@prefix : <urn:x:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
        :A rdfs:subClassOf :B . :B rdfs:subClassOf :C . :A rdfs:subClassOf :C . :kind rdfs:subPropertyOf rdf:type . :x :kind :A . :y a :B .""")
    all_ = entailment.rdfs_closure(g.triples)
    got = [(r["s"]["lex"][-1], r["p"].split("#")[-1], r["o"]["lex"].split(":")[-1]) for r in all_.collect()]
    assert len(got) == len(set(got)) and {t for t in got if t[1] == "type"} == {("x", "type", c) for c in "ABC"} | {("y", "type", c) for c in "BC"}
    assert not all_._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
