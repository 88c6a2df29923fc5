"""Turtle cut into splits of a few bytes against the small parser; every escape of N-Triples."""

import re

import pytest

from quadrille.errors import GraphError
from quadrille.sources import turtle
from quadrille.sources.turtle import load_graph, load_ntriples, parse_turtle, unescaped

HEAD = "@prefix : <urn:quadrille:> . # a remark with a dot. and \"quotes\"\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\nPREFIX e: <urn:e:>\n@base <urn:base/> .\n"


def document(n=40):
    out = [HEAD]
    for i in range(n):
        out.append(f':A{i} a :C ; :p {i}.5 , "x.{i} \\" ] . (" , \'y\' ;\n  e:q <r{i}> , "t"@en , "2020-01-01"^^xsd:date .\n')
        if i % 7 == 0:
            out.append(f':L{i} :text """first line . [ \\"""\nsecond ( line . @prefix\n\n# no remark .\n""" , \'\'\'a "b"\n. \'\'\' .\n')
        if i % 9 == 0:
            out.append(f":B{i} :has [ :v {i} ;\n :w ( {i} :A{i} [ :u \"]\" ] ) ] .\n_:n{i} :see _:n{i - 9} .\n")
        if i == 30:
            out.append("@prefix e: <urn:other:> .\nBASE <urn:later/>\n")
    return "".join(out) + "# the end ."


def shape(rows):
    """The triples with blank nodes without a label told by what is said of them only."""
    one = lambda t: ("blank",) if t[0] == 1 and re.match("g", t[1]) else tuple(t)
    return sorted(((one(s), p, one(o)) for s, p, o in rows), key=repr)


@pytest.mark.parametrize("size", [300, 10**9])
def test_splits_of_any_size_give_the_same_graph(spark, tmp_path, size):
    path = tmp_path / "g.ttl"
    path.write_text(document(), encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        store = load_graph(spark, path)
        got = [(tuple(r["s"]), r["p"], tuple(r["o"])) for r in store.triples.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    want = parse_turtle(document())
    assert shape(got) == shape(want)
    blank = lambda rows: len({t[1] for s, _, o in rows for t in (s, o) if t[0] == 1})
    assert blank(got) == blank(want)


def test_files_have_their_own_prefixes_and_labels(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix : <urn:a:> . _:x :p :y .")
    (tmp_path / "b.ttl").write_text("@prefix : <urn:b:> . _:x :p :y .")
    rows = load_graph(spark, tmp_path).triples.collect()
    assert {(r["p"], r["o"]["lex"]) for r in rows} == {("urn:a:p", "urn:a:y"), ("urn:b:p", "urn:b:y")} and len({r["s"]["lex"] for r in rows}) == 2


def test_errors(spark, tmp_path):
    for i, (text, said) in enumerate([(":a :p :b .", "prefix"), ("@prefix : <urn:a:> . :a :p .\n:b :p :c .", "invalid Turtle"), ("<a> <b> <c>", "invalid Turtle")]):
        (tmp_path / f"{i}.ttl").write_text(text)
        with pytest.raises(GraphError, match=said):
            load_graph(spark, tmp_path / f"{i}.ttl")
    (tmp_path / "none.ttl").write_text("\n# nothing .\n")
    assert load_graph(spark, tmp_path / "none.ttl").size() == 0


def test_every_escape_of_n_triples(spark, tmp_path):
    text = 'tab\\t back\\b line\\n cr\\r form\\f quote\\" apos\\\' slash\\\\n caf\\u00e9 \\U0001F600 \\\\u0041'
    (tmp_path / "g.nt").write_text(f'<urn:caf\\u00e9> <urn:p> "{text}" . # said\n\n_:b <urn:p> "x"^^<urn:\\u0064t> .\n_:b <urn:q> <urn:\\U0001F600> .\n<urn:s> <urn:p> "{"long " * 20_000}"@EN .\n')
    rows = {(r["s"]["lex"], r["p"]): r["o"] for r in load_ntriples(spark, str(tmp_path / "g.nt")).triples.collect()}
    assert rows["urn:café", "urn:p"]["lex"] == "tab\t back\b line\n cr\r form\f quote\" apos' slash\\n café \U0001f600 \\u0041"
    assert rows["b", "urn:p"]["dt"] == "urn:dt" and rows["b", "urn:q"]["lex"] == "urn:\U0001f600"
    assert rows["urn:s", "urn:p"]["lang"] == "en" and len(rows["urn:s", "urn:p"]["lex"]) == 100_000
    got = spark.createDataFrame([("a\\",), ("none",), (None,)], "t string").where("t IS NULL OR t = 'none'").select(unescaped(turtle.F.col("t"))).collect()
    assert [r[0] for r in got] == ["none", None]
    with pytest.raises(Exception, match="unknown escape"):
        spark.createDataFrame([("bad \\q",)], "t string").select(unescaped(turtle.F.col("t"))).collect()


def test_the_number_of_jobs_is_not_that_of_the_splits(spark, tmp_path):
    path, sc, was = tmp_path / "g.ttl", spark.sparkContext, spark.conf.get("spark.sql.files.maxPartitionBytes")
    path.write_text(document(200), encoding="utf-8")
    jobs = []
    try:
        for size in (300, 10**9):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            sc.setJobGroup(f"turtle-{size}", "")
            load_graph(spark, path)
            jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"turtle-{size}")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] <= jobs[1] + 2


def test_flat_statements_are_read_as_the_parser_reads_them():
    prefixes, base = {"": "urn:e:", "p": "urn:p:"}, "urn:base/"
    flat = ['<a> a :C , p:D.e ; :p "x\\n" , ""@EN-us , """l\n"q" """^^p:d;<q> -5 ,+.5,1e3 , 7.', "p:s :p 'x' .", ":a :p -+5 .", 'x:a :p "b" .', ":a :p _:b .", ':a :p "\\q" .', ":a :p :b ; .", ":a :p 1 . :b :p 2 ."]
    got = [turtle._flat(text, prefixes, base) for text in flat]
    assert got[0] == [(turtle._row(t.s), t.p.value, turtle._row(t.o)) for t in turtle._Turtle(flat[0], prefixes, base).document()] and len(got[0]) == 9
    assert got[1:] == [None] * 7
