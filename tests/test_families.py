"""Many texts as one plan: the same answers, errors and flags as text by text."""

import pytest

from quadrille.errors import SparqlError
from quadrille.operators import evaluation
from quadrille.plans import families
from quadrille.plans.guard import validate_select
from quadrille.sources.mapped import MappedGraph

TEXTS = [
    *[f"SELECT ?a WHERE {{ :Nation{i} :region/rdfs:label ?a . }}" for i in range(6)],
    *[f'SELECT  ?a WHERE {{ # says\n :Nation{i} rdfs:label ?a . FILTER(?a != "CHINA") }}' for i in (3, 18)],
    *[f"SELECT (COUNT(?c) AS ?n) (MAX(?b) AS ?m) WHERE {{ ?c :nation :Nation{i} ; :balance ?b . FILTER(?b > {j}) }}" for i in (0, 99) for j in (0, 5000)],
    *[f"SELECT ?n WHERE {{ ?c :nation :Nation{i} ; rdfs:label ?n ; :balance ?b . }} ORDER BY DESC(?b) LIMIT {k} OFFSET 1" for i in (1, 2) for k in (2, 3)],
    *[f'SELECT ?n WHERE {{ ?c :segment "{s}" ; rdfs:label ?n . FILTER NOT EXISTS {{ ?o :customer ?c ; :status "{t}" . }} }}' for s in ("BUILDING", "none") for t in "FO"],
    *[f'SELECT ?a ?b WHERE {{ ?c rdfs:label ?a . ?c :nation :Nation{i} . OPTIONAL {{ ?c :segment "BUILDING" ; :balance ?b . FILTER(?b > 0) }} }}' for i in (3, 4)],
    *[f"SELECT ?a WHERE {{ {{ :Nation{i} rdfs:label ?a . }} UNION {{ :Region{i} rdfs:label ?a . }} }}" for i in (1, 2, 7)],
    *[f"SELECT ?g (COUNT(?a) AS ?s) WHERE {{ ?c :balance ?a ; :nation :Nation{i} ; :segment ?g . }} GROUP BY ?g HAVING (COUNT(?a) > 1)" for i in (3, 5)],
    *[f"SELECT ?a WHERE {{ ?c :balance ?a . FILTER(?c = :Customer{i} || ?c = :Customer3) }}" for i in (7, 8)],
    *[f"SELECT ?a WHERE {{ ?n rdfs:label ?a . MINUS {{ ?n :region :Region{i} . }} ?n :region ?r . }}" for i in (1, 2)],
    *[f"SELECT ?a WHERE {{ {{ SELECT ?n WHERE {{ ?n :region :Region{i} . }} ORDER BY ?n LIMIT {i} }} ?n rdfs:label ?a . }}" for i in (1, 2)],
    *[f"SELECT DISTINCT ?a WHERE {{ VALUES ?n {{ :Nation{i} :Nation2 }} ?n (rdfs:label|:region/rdfs:label) ?a . }}" for i in (1, 2)],
    'SELECT (STR(?p) AS ?q) WHERE { :Nation1 ?p "ARGENTINA" . }', 'SELECT ?a WHERE { :Nation3 rdfs:label "x\\ty" ; rdfs:label ?a . }', "SELECT ?a WHERE { :Customer007 rdfs:label ?a . }",
    "SELECT ?a WHERE { :Nope7 rdfs:label ?a . }", "SELECT ?a WHERE { :Nope rdfs:label ?a . }", "SELECT ?n WHERE { :Nation1 :region ?n . }", "SELECT ?a WHERE { ?c :balance ?a . }", "SELECT ?x WHERE { ?x 7", "SELECT * WHERE {?s ?p ?o}",
    "", "DROP ALL", f"SELECT ?a WHERE {{ :Nation1 rdfs:label ?a . }} # {'x' * 5000}", 'SELECT ?a WHERE { :Nation1 rdfs:label ?a . FILTER(?a != "from here") }', 'SELECT ?a WHERE { :Nation1 rdfs:label ?a . FILTER(?a != "bad \\q") }', "SELECT ?a WHERE { :Nation1 rdfs:label ?a . } ~",
]


@pytest.fixture(scope="module")
def graph(spark, sf_dir):
    return MappedGraph(spark, sf_dir)


def alone(graph, text):
    try:
        validate_select(text)
    except SparqlError as e:
        return False, False, str(e), None
    return evaluation._alone(graph, text, 100)[1:]


def test_the_same_as_one_by_one(spark, graph):
    found = {r["query"]: (r["parse_ok"], r["execution_ok"], r["error"], r["rows"]) for r in evaluation.run_queries(graph, spark.createDataFrame([(t,) for t in TEXTS * 2], "q string"), spark).collect()}
    assert set(found) == set(TEXTS)
    for t in TEXTS:
        want = alone(graph, t)
        assert found[t][:2] == want[:2], (t, found[t], want)
        assert [[*r] for r in found[t][3] or []] == [[*r] for r in want[3] or []] and (found[t][3] is None) == (want[3] is None), (t, found[t], want)
        assert (found[t][2] or "")[:30] == (want[2] or "")[:30], (t, found[t], want)


def test_ten_thousand_texts_of_two_shapes_run_as_two_plans(spark, graph, monkeypatch):
    ran, plan = [], families.plan
    monkeypatch.setattr(evaluation, "plan", lambda *a: ran.append(1) or plan(*a))
    texts = spark.range(10_000).selectExpr("IF(id % 2 = 0, 'SELECT ?b WHERE { :Customer' || id || ' :balance ?b . }', 'SELECT ?v WHERE { :Order' || id || ' :status ?v ; :total ?t . FILTER(?t > ' || id || ') }') AS q")
    got = evaluation.run_queries(graph, texts, spark)
    assert got.count() == 10_000 and got.where("execution_ok").count() == 10_000 and len(ran) == 2
    want = spark.read.parquet(f"{graph.dir}/customer.parquet").where("c_custkey % 2 = 0 AND c_custkey < 10000").count()
    assert got.where("query LIKE '%Customer%' AND size(rows) = 1").count() == want


def test_a_plan_that_fails_leaves_other_texts_their_answers(spark, graph, monkeypatch):
    monkeypatch.setattr(evaluation, "_answers", lambda *a: (_ for _ in ()).throw(RuntimeError("no")))
    text = TEXTS[0]
    got = evaluation.run_queries(graph, spark.createDataFrame([(text,)], "q string"), spark).collect()
    assert [(r["parse_ok"], r["execution_ok"], r["error"], r["rows"]) for r in got] == [alone(graph, text)]


def test_no_texts(spark, graph):
    assert evaluation.run_queries(graph, spark.createDataFrame([], "q string"), spark).collect() == []


def test_texts_of_a_shape_are_not_dealt_by_their_shape(spark, graph, monkeypatch):
    plans, write = [], evaluation.materialize
    monkeypatch.setattr(evaluation, "materialize", lambda df, by=(): plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, by))
    texts = spark.range(50).selectExpr("concat('SELECT ?a WHERE { :Nation', id, ' rdfs:label ?a . }') AS query")
    assert evaluation.run_queries(graph, texts, spark).where("size(rows) = 1").count() == 25
    joins = [line for p in plans for line in p.splitlines() if "Join" in line and "shape" in line]
    assert joins and all("hint" in line or "broadcast" in line for line in joins)


def test_one_result_of_a_text_is_joined_by_hashes_counted_once(spark, monkeypatch):
    from quadrille.operators import skew

    counted, hot = [], skew.hot_keys
    monkeypatch.setattr(skew, "hot_keys", lambda rows, *a, **k: counted.append(rows.schema.simpleString()) or hot(rows, *a, **k))
    left = spark.range(3000).selectExpr("id", "if(id % 2 = 0, 'x', concat('t', id)) AS k")
    right = left.select("k").distinct().selectExpr("k", "upper(k) AS v")
    got = skew.spread_join(left.withColumnRenamed("id", "i"), right, ["k"], skew.F.xxhash64("i"), total=3000, counted=left)
    assert got.where("v = upper(k)").count() == got.count() == 3000 and counted == ["struct<__hash:bigint>"]
