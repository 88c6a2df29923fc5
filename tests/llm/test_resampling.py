"""Importance resampling against pure Python on texts with nulls, ties, repeats and hot buckets."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quadrille.llm import resampling
from quadrille.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import assert_same, connect

SCHEMA = "doc_id long, text string, rank int, score string, buckets string, n_words int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=1):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, aims, share=10, longest=1):
    pool, target = Counter(), Counter()
    for _, t in rows:
        pool.update(features(t, longest)[1])
    for t in aims:
        target.update(features(t, longest)[1])
    s, t = sum(pool.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s + 10000.0) / ((pool[b] + 1) * (t + 10000.0)))) for b in range(10000)]
    out = []
    for i, text in rows:
        n, f = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    open_ = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(open_[: share * len(open_) // 100])}
    return [(r[0], r[2], r[3], r[4], ranks.get(id(r))) for r in out]


def table():
    rng = random.Random(1)
    words = [f"{rng.choice(['wort', 'Mot', 'x', 'ÄB'])}{rng.randrange(60)}" for _ in range(300)]
    texts = [None, "", " \n", "one", "the " * 5000, "ein-zwei;DREI 4_5 日本 ß", "the " * 19, "the " * 20]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(150)]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("share", "longest"), [(10, 1), (100, 1), (0, 1), (33, 3)])
def test_scores_and_ranks(spark, share, longest):
    rows = table()
    aims = ["wort1 wort2 Mot3", None, "the end", ""]
    df = spark.createDataFrame([(i, t, 5, "x", "y", None) for i, t in rows], SCHEMA).repartition(3)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in aims], "text string"), share=share, longest=longest)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows, aims, share, longest))


def test_repeated_rows_each_have_a_rank_and_null_ids_come_last(spark):
    rows = [(7, "the same words again " * 6)] * 40 + [(None, "the same words again " * 6)] * 2
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("the",)], "text string"), share=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 43))
    score = {r["doc_id"]: r["score"] for r in got}
    assert {r["rank"] for r in got if r["doc_id"] is None} == ({41, 42} if score[None] <= score[7] else {1, 2})


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    got = resampling.resample(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), none).collect()
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in got] == [(1, 2, None)]


def test_drawn_documents_keep_their_columns(spark):
    rows = table()
    df = spark.createDataFrame([(i, t, 5, "x", "y", None) for i, t in rows], SCHEMA)
    got = resampling.drawn_documents(df, spark.createDataFrame([("the",)], "text string"), share=20)
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == {r[0] for r in plain(rows, ["the"], 20) if r[4] is not None}


def test_query_agrees_with_sql(spark, sf_dir):
    assert assert_same(QUERIES["op12_importance_resampling"](spark, sf_dir), connect(sf_dir), ORACLE_SQL["op12_importance_resampling"]) > 0
