"""Releases as committed versions: order over parts, writes that die half way."""

import json

import pytest
from pyspark.sql import functions as F

from quadrille.sources import jsonl

SCHEMA = "id string, query_id string, register string, input string, target string, split string, _pos long"


def release(spark, tag, n=300):
    rows = [(f"{tag}{i}", "f", "formal", f"line one\nof {i} \"x\"", ":A", ("train", "val", "test")[i % 3], i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def ids(spark, folder):
    return [r["id"] for r in jsonl.load_release(spark, folder).where("split = 'train'").orderBy("_pos").collect()]


def test_order_is_kept_over_parts_and_versions_replace_each_other(spark, tmp_path):
    folder = str(tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        first = jsonl.write_release(release(spark, "a"), folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ids(spark, folder) == [f"a{i}" for i in range(0, 300, 3)]
    parts = list((tmp_path / first.rsplit("/", 1)[1] / "train.jsonl").glob("part-*"))
    assert len(parts) > 1
    made = json.loads((tmp_path / first.rsplit("/", 1)[1] / "manifest.json").read_text())
    assert made["splits"]["train"]["records"] == 100 and len([n for n in made["files"] if n.startswith("train.jsonl/part-")]) == len(parts)
    jsonl.write_release(release(spark, "b", 30), folder, [F.desc("_pos")])
    assert ids(spark, folder) == [f"b{i}" for i in range(27, -1, -3)]


@pytest.mark.parametrize("at", ["manifest.json", jsonl.COMMITS, "val.jsonl"])
def test_a_write_that_dies_leaves_the_old_release(spark, tmp_path, monkeypatch, at):
    folder = str(tmp_path)
    jsonl.write_release(release(spark, "a"), folder)
    put, write = jsonl._put_text, jsonl.write_jsonl

    def dies(what, path):
        if at in path:
            raise RuntimeError("killed")
        return what

    monkeypatch.setattr(jsonl, "_put_text", lambda s, path, text: dies(put, path)(s, path, text))
    monkeypatch.setattr(jsonl, "write_jsonl", lambda df, path, order: dies(write, path)(df, path, order))
    with pytest.raises(RuntimeError, match="killed"):
        jsonl.write_release(release(spark, "b"), folder)
    assert ids(spark, folder) == [f"a{i}" for i in range(0, 300, 3)]


def test_a_folder_without_versions_is_read_as_it_is(spark, tmp_path):
    for s in jsonl.SPLITS:
        jsonl.write_jsonl(release(spark, s, 9).where(F.col("split") == s).drop("split"), f"{tmp_path}/{s}.jsonl")
    assert jsonl.committed(spark, str(tmp_path)) is None and len(ids(spark, str(tmp_path))) == 3


def test_lines_are_parsed_once_and_faults_keep_their_messages(spark, tmp_path):
    good = {"id": "a", "query_id": "q", "register": "formal", "input": "x\ny   \"", "target": ""}
    path = tmp_path / "good.jsonl"
    path.write_text(json.dumps(good) + "\n" + json.dumps(dict(reversed(good.items()))) + "\n")
    read = jsonl.load_dataset(spark, str(path))
    assert not [f for f in read.inputFiles() if f.endswith("good.jsonl")]  # what was checked is what is read later
    assert [r.asDict() for r in read.orderBy("_pos").collect()] == [good | {"_pos": 1}, good | {"_pos": 2}]
    for line, said in [(json.dumps(good | {"id": 1}), "strings"), (json.dumps(good | {"id": None}), "strings"), (json.dumps(good | {"more": "x"}), "exactly"), ("[1]", "object"), ("{", "JSON"), (json.dumps(good | {"target": ["x"]}), "strings")]:
        (tmp_path / "bad.jsonl").write_text(json.dumps(good) + "\n\n" + line + "\n")
        with pytest.raises(ValueError, match=f"line 3: .*{said}"):
            jsonl.load_dataset(spark, str(tmp_path / "bad.jsonl"))
