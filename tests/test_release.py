"""Whole jobs: the first violation in order, benchmark rules, pairing, reports, joins on variables that may be unbound."""

import os

import pytest
from pyspark.sql import functions as F

from quadrille import engine, scratch, workloads
from quadrille.errors import BenchmarkError, DatasetError
from quadrille.operators import catalogue as cat
from quadrille.operators import release
from quadrille.sources.mapped import MappedGraph

FAMILIES = {
    "nation_region": workloads._NATION,
    "region_name": cat.Family("region_name", "nation", "SELECT ?a WHERE { ${r} rdfs:label ?a . }", {"r": cat.Slot("iri", (":Region0", ":Region1"))}),
}
SCHEMA = "id string, query_id string, register string, input string, target string, split string, _pos long"


def row(i, split, n, register="formal", **changed):
    r = {"id": f"{split}{i}", "query_id": "nation_region", "register": register, "input": f"question {i * 7919} of {split} {'abcdefghij'[i] * 9}", "target": f"SELECT ?a WHERE {{ :Nation{n} :region/rdfs:label ?a . }}", "split": split, "_pos": i}
    return tuple((r | changed).values())


def good():
    registers = ("formal", "neutral", "colloquial", "noisy")
    rows = [row(i, "train", i, registers[i % 4]) for i in range(4)]
    return rows + [row(i, s, 5 + i, registers[i]) for s in ("val", "test") for i in range(2)]


@pytest.fixture(scope="module")
def graph(spark, sf_dir):
    return MappedGraph(spark, sf_dir)


ONE = {"nation_region": FAMILIES["nation_region"]}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_valid_release(spark, graph):
    found = {(r["split"], r["name"], r["key"]): r["n"] for r in release.validate_release(frame(spark, good()), ONE, graph).collect()}
    assert found["train", "records", ""] == 4 and found["val", "targets", ""] == 2 and found["test", "domain", "nation"] == 2
    report = release.dataset_report(frame(spark, good()), ONE, _Both(graph, spark), spark.createDataFrame([("train.jsonl", "abc")], "name string, sha256 string"))
    assert report["dataset"]["records"] == 8 and report["dataset"]["splits"]["train"]["records"] == 4 and report["sha256"] == {"train.jsonl": "abc"}


class _Both:
    """A mapped graph whose triples are a table, as a report reads them."""

    def __init__(self, graph, spark):
        self.__dict__ |= graph.__dict__ | {"graph": graph, "triples": workloads.graph_of(spark, workloads._INVENTORY).triples}

    def __getattr__(self, name):
        return getattr(self.graph, name)


@pytest.mark.parametrize(
    ("place", "changed", "said"),
    [
        (1, {"input": " "}, "blank"), (1, {"id": "train0"}, "duplicate id"), (2, {"register": "loud"}, "register"), (2, {"query_id": "other"}, "unknown query_id"),
        (3, {"target": "SELECT ?a\nWHERE { :Nation1 :region/rdfs:label ?a . }"}, "text"), (3, {"target": "SELECT ?a WHERE { :Nation1 rdfs:label ?a . }"}, "does not match"),
        (0, {"target": "SELECT ?a WHERE { :Nation999 :region/rdfs:label ?a . }"}, "returns no rows"), (5, {"split": "dev"}, "exactly"),
    ],
)
def test_the_first_violation_is_raised(spark, graph, place, changed, said):
    rows = good()
    names = SCHEMA.replace(" string", "").replace(" long", "").split(", ")
    rows[place] = tuple(changed.get(n, v) for n, v in zip(names, rows[place], strict=True))
    rows[7] = rows[7][:2] + ("louder", *rows[7][3:]) if said != "register" else rows[7]
    with pytest.raises(DatasetError, match=said):
        release.validate_release(frame(spark, rows), ONE, graph)


def test_release_rules_in_order(spark, graph):
    rows = good()
    for cut, said in (([0], "fewer than four"), ([4, 5], "missing from splits|exactly"), ([4], "fewer than two val")):
        with pytest.raises(DatasetError, match=said):
            release.validate_release(frame(spark, [r for i, r in enumerate(rows) if i not in cut]), ONE, graph)
    again = [*rows, row(9, "test", 7, "noisy", input=rows[0][3])]
    with pytest.raises(DatasetError, match="inputs cross splits"):
        release.validate_release(frame(spark, again), ONE, graph)
    text = "which of the regions of the world does the nation with this number belong to, please"
    near = [row(0, "train", 0, input=text), *rows[1:], row(9, "test", 7, "noisy", input=f"{text}!")]
    with pytest.raises(DatasetError, match="near-duplicate"):
        release.validate_release(frame(spark, near), ONE, graph)
    with pytest.raises(DatasetError, match="missing from splits"):
        release.validate_release(frame(spark, rows), FAMILIES, graph)


def test_benchmark_rules(spark, graph):
    rows = good()
    train, test = frame(spark, rows[:4]), frame(spark, rows[6:])
    found = {r["name"]: r["n"] for r in release.validate_benchmark(test, FAMILIES, graph, train).collect() if r["key"] == ""}
    assert found == {"records": 2, "queries": 1, "targets": 2, "queries_supported_by_train": 1}
    region = lambda i, split, r: row(i, split, 0, query_id="region_name", target=f"SELECT ?a WHERE {{ :Region{r} rdfs:label ?a . }}")
    for extra, learnt, said in (
        (row(3, "test", 1, input=rows[0][3].upper()), [], "leaks from training"), (row(3, "test", 1, input=rows[6][3]), [], "duplicates"), (region(3, "test", 0), [], "absent from train"),
        (region(3, "test", 0), [region(5, "train", 1)], "slot values absent"), (region(3, "test", 7), [region(5, "train", 1)], "does not match"),
    ):
        with pytest.raises(BenchmarkError, match=said):
            release.validate_benchmark(frame(spark, [*rows[6:], extra]), FAMILIES, graph, frame(spark, rows[:4] + learnt))
    with pytest.raises(BenchmarkError, match="empty"):
        release.validate_benchmark(test.limit(0), FAMILIES, graph)


def test_pairing_is_strict(spark):
    e = spark.createDataFrame([("a", 0), ("b", 1)], "id string, _pos long")
    p = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "prediction string, _pos long")
    assert sorted((r["id"], r["prediction"]) for r in release.paired(e, p.where("_pos < 2")).collect()) == [("a", "x"), ("b", "y")]
    for left, right in ((e, p), (e, p.limit(1))):
        with pytest.raises(ValueError, match="same length"):
            release.paired(left, right)


def test_one_failure_withholds_the_model_report(spark):
    r = spark.createDataFrame([("a", True, True, "h", 4, 5), ("b", True, True, "h", 4, 5)], "model string, has_config boolean, merged boolean, manifest_sha256 string, validation_count long, benchmark_count long")
    assert release.eligible_models(r, {"validation": 4, "benchmark": 5}, "h").count() == 2
    assert release.eligible_models(r.withColumn("merged", F.col("model") != "b"), {"validation": 4, "benchmark": 5}, "h").count() == 0


@pytest.mark.parametrize("name", ["join_on_bind", "join_on_max"])
def test_computed_variables_join_by_equality(spark, sf_dir, name):
    plan = workloads.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_optional_variables_join_by_equality_where_bound(spark, sf_dir):
    """Bound rows meet by equality; only what is left unbound meets everything."""
    q = "SELECT ?a ?b WHERE { ?d a :Document ; :chars ?a . OPTIONAL { ?l :document ?d ; :quality ?q . } ?x a :Part ; :size ?q ; rdfs:label ?b . }"
    plan = engine.query_frame(MappedGraph(spark, sf_dir), q)._jdf.queryExecution().optimizedPlan().toString()
    assert "v_q" in plan and "OR isnull" not in plan


def test_unbound_variables_fit_anything(spark):
    """All kinds of joins on variables that either side may leave unbound, against the definition."""
    from quadrille.plans.solution import Binding, Solution, join, left_join, minus, semi_join
    from quadrille.plans.terms import Rep

    rep = Rep("int")
    a_rows, b_rows = [(x, y, i) for i, (x, y) in enumerate([(1, 1), (1, None), (None, 1), (None, None), (2, 1), (3, None)])], [(x, y, 10 + i) for i, (x, y) in enumerate([(1, 1), (None, 1), (1, None), (None, None), (2, 2)])]
    side = lambda rows, own: Solution(spark.createDataFrame(rows, f"v_x long, v_y long, v_{own} long"), {"x": Binding(rep, True), "y": Binding(rep, True), own: Binding(rep)})
    fits = lambda p, q: all(u is None or v is None or u == v for u, v in zip(p[:2], q[:2], strict=True))
    shared = lambda p, q: any(u is not None and v is not None for u, v in zip(p[:2], q[:2], strict=True))
    both = lambda p, q: (*[u if u is not None else v for u, v in zip(p[:2], q[:2], strict=True)], p[2], q[2])
    key = lambda rows: sorted(rows, key=str)
    for bs in (b_rows, b_rows[:1] + b_rows[4:], b_rows[2:3]):
        a, b = side(a_rows, "a"), side(bs, "b")
        got = lambda s, *names: key(tuple(r) for r in s.df.select(*[f"v_{n}" for n in names]).collect())
        inner = [both(p, q) for p in a_rows for q in bs if fits(p, q)]
        assert got(join(a, b), "x", "y", "a", "b") == key(inner)
        alone = [(*p, None) for p in a_rows if not any(fits(p, q) for q in bs)]
        assert got(left_join(a, b, None), "x", "y", "a", "b") == key(inner + alone)
        assert got(semi_join(a, b, None, False), "a") == key((p[2],) for p in a_rows if any(fits(p, q) for q in bs))
        assert got(semi_join(a, b, None, True), "a") == key((p[2],) for p in a_rows if not any(fits(p, q) for q in bs))
        assert got(minus(a, b), "a") == key((p[2],) for p in a_rows if not any(fits(p, q) and shared(p, q) for q in bs))


def test_timezone_is_a_duration(spark):
    g = workloads.graph_of(spark, '@prefix : <urn:quadrille:> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . :a :t "2020-01-01T00:00:00-08:30"^^xsd:dateTime . :b :t "2020-01-01T00:00:00Z"^^xsd:dateTime .')
    found = engine.execute_select(g, "SELECT (STR(TIMEZONE(?t)) AS ?d) WHERE { ?x :t ?t . }")
    assert sorted(r["d"] for r in found) == ["-PT8H30M", "PT0S"]


def test_scratch_tables_go(spark):
    scratch.materialize(spark.range(3))
    path = scratch._made[-1].removeprefix("file:")
    assert os.path.exists(path)
    kept, scratch._made[:] = scratch._made[:-1], scratch._made[-1:]
    scratch.release(spark)
    scratch._made[:] = kept
    assert not os.path.exists(path)
