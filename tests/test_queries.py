"""The query language on a small graph: results, guard, projection."""

import pytest

from quadrille.engine import NO_INFORMATION_REPLY, QuestionAnswerer, execute_select, handle_chat, render_rows
from quadrille.errors import SparqlError
from quadrille.plans.guard import validate_select
from quadrille.sources.turtle import graph_of

GRAPH = """
@prefix : <urn:quadrille:> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:Depot1 a :Depot ; rdfs:label "Kho Bắc"@vi ; :email "north@example.org" .
:Depot2 a :Depot ; rdfs:label "Kho Nam"@vi .
:Item1 a :Item ; :storedIn :Depot1 ; :tag "mới"@vi , "cũ"@vi ; :price "600"^^xsd:nonNegativeInteger .
:Item2 a :Item ; :storedIn :Depot2 ; :price 450 .
:BandLow a :Band ; :min 0.0 ; :max 4.9 ; :result "low" .
:BandHigh a :Band ; :min 5.0 ; :max 10.0 ; :result "high" .
:Rate0 a :Rate ; :amount 500 . :Rate63 a :Rate ; :amount 600 ; :since 63 . :Rate66 a :Rate ; :amount 620 ; :since 66 .
:N1 :next :N2 . :N2 :next :N3 . :N3 :next :N1 . :N1 :code "a" . :N2 :code "b" . :N3 :code "c" .
:Flag :on true ; :site "https://example.org/x"^^xsd:anyURI .
"""


@pytest.fixture(scope="module")
def graph(spark):
    g = graph_of(spark, GRAPH)
    g.triples = g.triples.cache()
    return g


BAND = "?a WHERE { ?b a :Band ; :min ?l ; :max ?h ; :result ?a . FILTER (?l <= %s && %s <= ?h) }"
RATE = "?a WHERE { ?r a :Rate ; :amount ?a . OPTIONAL { ?r :since ?f . } FILTER (!BOUND(?f) || %d >= ?f) } ORDER BY DESC(?f) LIMIT 1"
CASES = [
    ("?a WHERE { :Item1 :storedIn ?d . ?d rdfs:label ?a . }", ["Kho Bắc"]),
    ("?a WHERE { :Item1 :storedIn/rdfs:label ?a . }", ["Kho Bắc"]),
    ("?a WHERE { :Item1 :tag ?a . } ORDER BY ?a", ["cũ", "mới"]),
    ("?a WHERE { :Item1 :price ?a . }", [600]),
    ("?a WHERE { :BandHigh :max ?a . }", ["10.0"]),
    (BAND % ("8.5", "8.5"), ["high"]),
    (BAND % ("4.95", "4.95"), []),
    (RATE % 60, [500]),
    (RATE % 65, [600]),
    (RATE % 70, [620]),
    ("(COUNT(DISTINCT ?t) AS ?a) WHERE { :Item1 :tag ?t . }", [2]),
    ('?a WHERE { :Item1 :tag ?a . FILTER (?a = "mới"@vi) }', ["mới"]),
    ('?a WHERE { :Item1 :tag ?a . FILTER (?a = "mới") }', []),
    ("?a WHERE { ?d a :Depot ; rdfs:label ?a . FILTER NOT EXISTS { ?d :email ?e . } }", ["Kho Nam"]),
    ('?a WHERE { VALUES ?a { "A" "A" } }', ["A", "A"]),
    ("?a WHERE { :N1 :next+ ?n . ?n :code ?a . } ORDER BY ?a", ["a", "b", "c"]),
    ("?a WHERE { :N1 :next* ?n . ?n :code ?a . } ORDER BY ?a", ["a", "b", "c"]),
    ("?a WHERE { ?n :next+ :N2 . ?n :code ?a . } ORDER BY ?a", ["a", "b", "c"]),
    ("?a WHERE { :N1 :next? ?n . ?n :code ?a . } ORDER BY ?a", ["a", "b"]),
    ("?a WHERE { :N1 ^:next ?n . ?n :code ?a . }", ["c"]),
    ("?a WHERE { :Item2 !(:storedIn|rdf:type) ?a . }", [450]),
    ("?a WHERE { { :N1 :code ?a . } UNION { :N2 :code ?a . } } ORDER BY DESC(?a)", ["b", "a"]),
    ("?a WHERE { ?d a :Depot ; rdfs:label ?a . MINUS { ?d :email ?e . } }", ["Kho Nam"]),
    ("(SUM(?p) AS ?a) WHERE { ?i a :Item ; :price ?p . }", ["1050.0"]),
    ("(SUM(?p) AS ?a) WHERE { ?i a :Nothing ; :price ?p . }", ["0.0"]),
    ("(SUM(?p) AS ?a) WHERE { ?n :code ?p . }", [None]),
    ("(MAX(?p) AS ?a) WHERE { ?i :price ?p . }", [600]),
    ('(GROUP_CONCAT(?c; SEPARATOR="|") AS ?a) WHERE { ?n :code ?c . }', ["a|b|c"]),
    ("?a WHERE { :Flag :on ?a . }", [True]),
    ("?a WHERE { :Flag :site ?a . }", ["https://example.org/x"]),
    ("(LANG(?x) AS ?a) WHERE { :Depot1 rdfs:label ?x . }", ["vi"]),
    ("?a WHERE { { SELECT ?n WHERE { ?n :next :N1 . } } ?n :code ?a . }", ["c"]),
    ("(?p * 2 + 1 AS ?a) WHERE { :Item2 :price ?p . }", ["901.0"]),
    ("DISTINCT ?a WHERE { ?s ?p ?a . FILTER (isNumeric(?a) && ?a > 610) }", [620]),
]


@pytest.mark.parametrize("query,expected", CASES)
def test_select(graph, query, expected):
    assert [r["a"] for r in execute_select(graph, f"SELECT {query}")] == expected


def test_pattern_order_does_not_matter(graph):
    a = execute_select(graph, "SELECT ?a ?p WHERE { ?i :storedIn ?d ; :price ?p . ?d rdfs:label ?a . } ORDER BY ?p")
    b = execute_select(graph, "SELECT ?a ?p WHERE { ?d rdfs:label ?a . ?i :price ?p . ?i :storedIn ?d . } ORDER BY ?p")
    assert a == b and len(a) == 2


def test_nodes_are_not_answers(graph):
    with pytest.raises(SparqlError, match="graph node"):
        execute_select(graph, "SELECT ?a WHERE { :Item1 :storedIn ?a . }")


def test_overflow_is_an_error(graph):
    with pytest.raises(SparqlError, match="exceeds 1 rows"):
        execute_select(graph, "SELECT ?a WHERE { ?s rdfs:label ?a . }", max_rows=1)


@pytest.mark.parametrize(
    "query,message",
    [
        (7, "must be text"), ("  ", "empty"), ("SELECT ?a " + "x" * 4097, "exceeds 4096"), ("ASK { ?s ?p ?o }", "only SELECT"), ("PREFIX x: <y> SELECT ?a {}", "only SELECT"),
        ("SELECT * WHERE { ?s ?p ?o }", "not allowed"), ("SELECT DISTINCT * WHERE { ?s ?p ?o }", "not allowed"), ("SELECT ?a WHERE { SERVICE <x> { ?a ?b ?c } }", "SERVICE"),
        ("SELECT ?a FROM <g> WHERE { ?a ?b ?c }", "FROM"), ('SELECT ?a WHERE { ?a :p "come with me" }', "WITH"), ("SELECT ?a WHERE { ?a ?b ?c ", "invalid"), ("SELECT ?a WHERE { GRAPH ?g { ?a ?b ?c } }", "default graph"),
    ],
)
def test_guard(query, message):
    with pytest.raises(SparqlError, match=message):
        validate_select(query)


def test_guard_returns_stripped_text():
    assert validate_select("  SELECT ?a WHERE { ?a ?b ?c } ") == "SELECT ?a WHERE { ?a ?b ?c }"


def test_render():
    assert render_rows([]) == NO_INFORMATION_REPLY
    assert render_rows([{"a": None}]) == "—"
    assert render_rows([{"a": 1}, {"a": True}]) == "- 1\n- True"
    assert render_rows([{"a": 1, "b": "x"}]) == "a: 1; b: x"


class Fixed:
    def __init__(self, text):
        self.text = text

    def generate(self, text):
        return self.text


def test_chat(graph):
    good = QuestionAnswerer(Fixed("SELECT ?a WHERE { :N1 :code ?a . }"), graph)
    assert handle_chat(good, {"message": "gì?"}) == (200, {"reply": "a"})
    assert handle_chat(good, {"message": " "})[0] == 400 and handle_chat(good, [])[0] == 400
    assert handle_chat(QuestionAnswerer(Fixed("không có thông tin"), graph), {"message": "x"}) == (200, {"reply": NO_INFORMATION_REPLY})
    assert handle_chat(QuestionAnswerer(Fixed("DROP"), graph), {"message": "x"}) == (200, {"reply": NO_INFORMATION_REPLY})
    with pytest.raises(AttributeError):
        handle_chat(QuestionAnswerer(None, graph), {"message": "x"})
