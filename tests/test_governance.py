"""Checks, catalogue, coverage, curation, evaluation and files on small hand-made data."""

import json

import pytest
from pyspark.sql import functions as F

from quadrille.errors import BenchmarkError, CatalogueError, CatalogueValidationError, CurationError, DatasetError
from quadrille.operators import catalogue as cat
from quadrille.operators import constraints as chk
from quadrille.operators import curation, evaluation, neardup, sets, summary
from quadrille.sources import jsonl
from quadrille.sources.turtle import graph_of, load_graph, load_ntriples

ROW = {"id": "q1", "query_id": "f", "register": "formal", "input": "a b", "target": ":A :p ?x ."}


def write(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_dataset_file(spark, tmp_path):
    df = jsonl.load_dataset(spark, write(tmp_path / "a.jsonl", ROW, "", ROW | {"id": "q2"}))
    assert [(r["_pos"], r["id"]) for r in df.orderBy("_pos").collect()] == [(1, "q1"), (3, "q2")]


@pytest.mark.parametrize("bad,message", [("{", "line 2: invalid JSON"), ("[1]", "line 2: not an object"), (ROW | {"x": 1}, "line 2: fields"), ({"id": "1"}, "line 2: fields"), (ROW | {"input": 5}, "line 2: fields must be strings")])
def test_dataset_faults(spark, tmp_path, bad, message):
    with pytest.raises(DatasetError, match=message):
        jsonl.load_dataset(spark, write(tmp_path / "b.jsonl", ROW, bad))


def test_predictions(spark, tmp_path):
    with pytest.raises(BenchmarkError, match="duplicate"):
        jsonl.load_predictions(spark, write(tmp_path / "p.jsonl", {"id": "1", "prediction": "x"}, {"id": "1", "prediction": "y"}))


def test_round_trip(spark, tmp_path):
    df = jsonl.load_dataset(spark, write(tmp_path / "a.jsonl", ROW, ROW | {"id": "q2", "input": "đ"}))
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    assert [r.asDict() for r in jsonl.load_dataset(spark, str(tmp_path / "out/*.txt")).collect()] == [r.asDict() for r in df.collect()]


def test_first_violation(spark):
    rows = spark.createDataFrame([(1, "a", "formal", ":A"), (2, "a", "loud", ":B"), (3, "b", "formal", "x  y"), (4, "c", "formal", "x_y")], "_pos long, id string, register string, target string")
    assert chk.first_violation(chk.duplicates(rows, "id"), chk.invalid_register(rows), chk.unsafe_text(rows)) == ("duplicate", "a", "a")
    assert {(r["record_id"], r["detail"]) for r in chk.unsafe_text(rows).collect()} == {("b", "line"), ("c", "characters")}
    with pytest.raises(DatasetError):
        chk.require(chk.empty_split(rows.limit(0)))


FAMILY = {"query_id": "f", "domain": "tuition", "target_template": "SELECT ?a WHERE { ${x} :p ?a . FILTER (${n} <= ?a && ?a <= ${n}) }", "slots": {"x": {"kind": "iri", "values": [":A", ":AB"]}, "n": {"kind": "number"}}, "coverage": [{"anchor_classes": ["C"], "paths": [["p"]]}]}


def test_match(spark):
    f = cat.parse_family(FAMILY)
    t = FAMILY["target_template"]
    fill = lambda x, a, b: t.replace("${x}", x).replace("${n}", a, 1).replace("${n}", b)
    rows = spark.createDataFrame([("f", fill(":AB", "8.5", "8.5")), ("f", fill(":A", "8.5", "8.50")), ("f", fill(":C", "1", "1")), ("g", fill(":A", "1", "1")), ("f", fill(":A", "08", "08"))], "query_id string, target string")
    assert [r["slots"] for r in cat.match_targets(rows, [f]).collect()] == [{"x": ":AB", "n": "8.5"}, None, None, None, None]
    cat.validate_template(f)
    assert cat.slot_product(f, spark).count() == 2


@pytest.mark.parametrize("change,message", [({"domain": "x"}, "domain"), ({"extra": 1}, "unexpected"), ({"slots": {}}, "slots"), ({"coverage": []}, "coverage"), ({"slots": FAMILY["slots"] | {"n": {"kind": "text"}}}, "kind")])
def test_catalogue_faults(change, message):
    with pytest.raises(CatalogueError, match=message):
        cat.parse_family(FAMILY | change)


def test_catalogue_file(spark, tmp_path):
    assert list(cat.load_catalogue(spark, write(tmp_path / "c.jsonl", FAMILY, FAMILY | {"query_id": "g"}))) == ["f", "g"]
    with pytest.raises(CatalogueError, match="duplicate"):
        cat.load_catalogue(spark, write(tmp_path / "d.jsonl", FAMILY, FAMILY))


def test_validate_catalogue(spark):
    g = graph_of(spark, "@prefix : <urn:quadrille:> . :A a :C ; :p 1 . :AB a :C ; :p 2 .")
    f = cat.parse_family(FAMILY)
    entries = spark.createDataFrame([("A-p", "A", ["p"], "supported"), ("AB-p", "AB", ["p"], "supported")], "id string, anchor string, path array<string>, status string")
    types = spark.createDataFrame([("A", ["C"]), ("AB", ["C"])], "anchor string, types array<string>")
    assert cat.validate_catalogue(g, entries, types, {"f": f}).count() == 0
    more = entries.union(spark.createDataFrame([("A-q", "A", ["q"], "supported")], entries.schema))
    with pytest.raises(CatalogueValidationError, match="without a family"):
        cat.validate_catalogue(g, more, types, {"f": f})


def test_near_duplicates_match_brute_force(spark):
    texts = ["abcdefghijklmnopqrst", "abcdefghijklmnopqrsu", "abcdefghijklmnopqrst", "zzz", "zzz", "", "một hai ba bốn năm sáu", "một hai ba bốn năm  sáu"]
    rows = [(i, "f" if i != 4 else "g", ("train", "val", "test")[i % 3], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, query_id string, split string, input string")

    def grams(t):
        p = "  " + " ".join(t.lower().split()) + "  "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    order = {"train": 0, "val": 1, "test": 2}
    expected = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and order[a[2]] < order[b[2]] and len(grams(a[3]) & grams(b[3])) / len(grams(a[3]) | grams(b[3])) >= 0.84}
    assert {(r["left_id"], r["right_id"]) for r in neardup.cross_split_near_duplicates(df).collect()} == expected


def test_curation(spark):
    rows = [("t2", "val", "procedure"), ("t1", "train", "out-of-domain"), ("t9", "train", "procedure"), ("t3", "train", "procedure"), ("t0", "test", "out-of-domain")]
    df = spark.createDataFrame(rows, "id string, split string, shard string")
    lists = spark.createDataFrame([("greeting", ["t0", "t1"])], "class string, ids array<string>")
    released, checklist = curation.assemble(df, lists)
    got = {r["id"]: r["release_id"] for r in released.collect()}
    assert got == {"t3": "question-000001", "t9": "question-000002", "t1": "question-000003", "t2": "question-000004", "t0": "question-000005"}
    assert checklist.first()["ids"] == ["question-000005", "question-000003"]
    with pytest.raises(CurationError, match="out-of-domain"):
        curation.assemble(df, spark.createDataFrame([("x", ["t2"])], "class string, ids array<string>"))
    with pytest.raises(CurationError, match="duplicate"):
        curation.assemble(df.union(df), lists)


def test_self_evaluation(spark):
    g = graph_of(spark, '@prefix : <urn:quadrille:> . :A :p "x" , "y" ; :q 1 .')
    examples = spark.createDataFrame(
        [("1", "f", "formal", "?", "SELECT ?a WHERE { :A :p ?a . }"), ("2", "f", "noisy", "?", "SELECT ?a WHERE { :A :q ?a . }"), ("3", "o", "noisy", "?", "không có thông tin")], "id string, query_id string, register string, input string, target string"
    )
    perfect = evaluation.evaluate_cases(examples, evaluation.reference_predictions(examples), g)
    overall = {r["scope"]: r for r in evaluation.scope_rates(perfect).collect()}
    assert overall["overall"]["system_answer_exact_rate"] == 1.0 and overall["in_domain"]["result_f1"] == 1.0 and overall["out_of_domain"]["marker_exact_rate"] == 1.0
    guesses = spark.createDataFrame([("1", 'SELECT ?b WHERE { :A :p ?b . FILTER (?b = "x") }'), ("3", "SELECT ?a WHERE { :A :q ?a . }")], "id string, prediction string")
    cases = {r["id"]: r for r in evaluation.evaluate_cases(examples, guesses, g, properties=["p", "q"]).collect()}
    assert (cases["1"]["result_precision"], cases["1"]["result_recall"], cases["1"]["error_category"]) == (1.0, 0.5, "wrong_literal")
    assert (cases["2"]["parse"], cases["2"]["error_category"]) == (False, "parse_error")
    assert (cases["3"]["false_acceptance"], cases["3"]["safe_rejection"], cases["3"]["error_category"]) == (True, False, "false_acceptance")


def test_empty_rates(spark):
    cases = spark.createDataFrame([], "marker boolean, parse boolean, execution boolean, answer_exact boolean, canonical_exact boolean, marker_exact boolean, false_acceptance boolean, safe_rejection boolean, system_answer_exact boolean, result_precision double, result_recall double, result_f1 double")
    assert set(cases.agg(*evaluation.rates()).first()) == {0, 0.0}


def test_summary(spark):
    s = summary.number_summary(spark.range(1, 11), F.col("id")).first()
    assert tuple(s) == (1, 6, 10, 10, 5.5)


def test_range_join_agrees(spark):
    points, bands = spark.range(100).select(F.col("id").cast("double").alias("v")), spark.createDataFrame([(0.0, 10.0), (5.0, 50.5), (90.0, 90.0)], "lo double, hi double")
    one, two = (sorted(map(tuple, sets.range_join(points, bands, "v", "lo", "hi", 7.0, bound=b).collect())) for b in (0, 10))
    assert one == two and len(one) == 11 + 46 + 1


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.ttl").write_text('@prefix : <urn:quadrille:> . :A :p "x"@vi , [ :q 1.50 ] . # note\n', encoding="utf-8")
    assert load_graph(spark, tmp_path / "g.ttl").size() == 3
    (tmp_path / "g.nt").write_text('<urn:a> <urn:p> "x\\ny"@VI .\n# c\n_:b <urn:p> <urn:a> .\n<urn:a> <urn:p> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .\n', encoding="utf-8")
    rows = {(r["s"]["k"], r["o"]["lex"], r["o"]["lang"]) for r in load_ntriples(spark, str(tmp_path / "g.nt")).triples.collect()}
    assert rows == {(0, "x\ny", "vi"), (1, "urn:a", None), (0, "1", None)}


def test_stores_agree(spark, sf_dir, tmp_path):
    from quadrille.engine import query_frame
    from quadrille.sources.mapped import MappedGraph
    from quadrille.sources.triples import TripleStore

    mapped = MappedGraph(spark, sf_dir)
    small = MappedGraph(spark, sf_dir, [t for t in mapped.tables if t.name in ("region", "nation")])
    small.triples().save(str(tmp_path / "t"))
    q = "SELECT ?a (COUNT(?n) AS ?k) WHERE { ?n :region/rdfs:label ?a . } GROUP BY ?a"
    stored = TripleStore.open(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, query_frame(mapped, q).collect())) == sorted(map(tuple, query_frame(stored, q).collect()))
    plan = query_frame(stored, q)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


def test_star_reads_its_table_once(spark, sf_dir):
    from quadrille.engine import query_frame
    from quadrille.sources.mapped import MappedGraph

    df = query_frame(MappedGraph(spark, sf_dir), "SELECT ?n ?s WHERE { ?c a :Customer ; rdfs:label ?n ; :segment ?s ; :balance ?b . FILTER (?b > 9000) }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "GreaterThan(c_acctbal" in plan


def test_stream(spark, sf_dir, tmp_path):
    from quadrille.streaming.questions import question_stream, windowed_counts

    source = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    s = question_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string")
    q = windowed_counts(s, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == source.count()
