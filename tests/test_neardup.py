"""Near duplicates across splits against all pairs: one family that holds all rows, lists cut into blocks of any size."""

import random

import numpy as np
import pytest

from quadrille.operators import neardup, skew

SCHEMA = "id long, query_id string, split string, input string"


def grams(text):
    t = f"  {' '.join(text.split()).lower()}  "
    return {t[i : i + 3] for i in range(len(t) - 2)}


def table(n, families):
    rng = random.Random(n)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.choice([12, 40, 41, 80]))) for _ in range(6)]
    out = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            t[rng.randrange(len(t))] = rng.choice("abcdxyz")
        out.append((i, rng.choice(families), rng.choice(["train", "val", "test", "more"]), "".join(t)))
    return [*out, (n, families[0], "val", None), (n + 1, families[0], "test", ""), (n + 2, None, "val", "abc"), (n + 3, None, "test", "abc")]


def all_pairs(rows, threshold):
    order = {"train": "0", "val": "1", "test": "2"}
    found = {}
    for i, f, s, t in rows:
        for j, g, u, v in rows:
            if f is not None and f == g and order.get(s, s) < order.get(u, u):
                a, b = grams(t or ""), grams(v or "")
                if (score := len(a & b) / len(a | b)) >= threshold:
                    found[i, j] = round(score, 9)
    return found


@pytest.mark.parametrize(("families", "block", "threshold"), [(["f"], 20, 0.84), (["f", "g", "h"], 2048, 0.84), (["f"], 7, 0.5)])
def test_against_all_pairs(spark, monkeypatch, families, block, threshold):
    monkeypatch.setattr(skew, "LEAST_ROWS", 50)
    rows = table(260, families)
    got = neardup.cross_split_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold=threshold, block=block).collect()
    mine = {(r["left_id"], r["right_id"]): round(r["score"], 9) for r in got}
    assert mine == all_pairs(rows, threshold) and len(got) == len(mine)


def test_blocks_of_one_list_are_even(spark):
    """One trigram shared by all texts of one family: block pairs have bounded numbers of entries, and far sizes do not meet."""
    n, block = 6000, 200
    entries = spark.range(n).selectExpr("'f' AS f", "7L AS g", "id AS node", "id % 2 AS side", "CAST(10 + id % 300 AS int) AS m", "0 AS r")
    lists = neardup.block_pairs(entries, 0.84, block).groupBy("list").count().collect()
    sizes = sorted(r["count"] for r in lists)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2] and sizes[-1] <= 2.5 * block
    assert len(sizes) < 0.5 * (n // block) ** 2 / 2


def test_no_rows(spark):
    assert neardup.cross_split_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketches_leave_few_pairs_open():
    """Texts of one small vocabulary share most rare trigrams; of their pairs only those near the threshold are left, and no similar one is lost."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(250)]
    texts = [" ".join(rng.choices(words, k=rng.choice([20, 60, 90, 200]))) for _ in range(300)]
    texts += [t.replace(words[i % 250], "zz") for i, t in enumerate(texts[:60])] + [t[: int(len(t) * 0.9)] for t in texts[:60]]
    sets = sorted(neardup.gram_sets(texts), key=len)
    assert all(np.array_equal(neardup.unpack(neardup.pack(s)), s) for s in sets)
    n = len(sets)
    whole, node, m = np.ones(n, np.int64), np.arange(n), np.array([len(s) for s in sets])
    sketches = np.array([*map(neardup.sketch, sets), None], object)[:-1]
    found = [tuple(sorted(p)) for pairs in neardup.close_pairs(whole, 0 * whole, node, node % 3, m, sketches, 0.84) for p in pairs.T.tolist()]
    kept = [set(s.tolist()) for s in sets]
    true = {(i, j) for i in range(n) for j in range(i + 1, n) if i % 3 != j % 3 and len(kept[i] & kept[j]) >= 0.84 * len(kept[i] | kept[j])}
    assert len(found) == len(set(found)) and true <= set(found) and len(true) > 30 and len(found) < 4 * len(true)


@pytest.mark.parametrize("head", [0, 40, 8192])
def test_shared_trigrams_of_many_pairs(monkeypatch, head):
    """Frequent trigrams by bits, rare ones by lists, the same counts wherever the line is drawn."""
    monkeypatch.setattr(neardup, "HEAD", head)
    monkeypatch.setattr(neardup, "TILE", 4)
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.choice([2, 60, 90]))) + rng.choice(["", "", "qq", "một"]) for _ in range(400)]
    sets = neardup.gram_sets(texts)
    kept, unpacked = [set(s.tolist()) for s in sets], []
    pairs = [np.stack([np.full(n, x), rng.sample(range(400), n)]) for x, n in ((3, 1), (7, 300), (399, 60), (3, 2))]

    def of(x):
        unpacked.append(x)
        return sets[x]

    found = list(neardup.shared(of, pairs))
    assert [f.tolist() for f in found] == [[len(kept[a] & kept[b]) for a, b in p.T.tolist()] for p in pairs]
    assert max(map(unpacked.count, set(unpacked))) <= 2


def test_similar_pairs_of_one_vocabulary(spark):
    """Long texts of few words are all similar, and some occur often: pairs are checked where they are found, no set travels with a pair."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.choice([150, 220]))) for _ in range(70)]
    texts += [texts[0]] * 9 + [texts[1]] * 5
    rows = [(i, "f", ("train", "train", "val", "test", "more")[i % 5], t) for i, t in enumerate(texts)] + [(900, "f", None, texts[0])]
    got = neardup.cross_split_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    mine = {(r["left_id"], r["right_id"]): round(r["score"], 9) for r in got.collect()}
    assert mine == all_pairs(rows[:-1], 0.84) and len(mine) == got.count() > 1000
    assert "grams" not in got._jdf.queryExecution().executedPlan().toString()
