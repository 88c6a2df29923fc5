"""The n-gram join against brute force where lists are long: edited copies by the hundred, shared lines, ids that repeat."""

import numpy as np
import pytest

from quadrille.llm import ngram_join


def _texts():
    rng = np.random.default_rng(3)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(4000)]
    words = lambda n: [vocabulary[i] for i in rng.integers(0, 4000, n)]
    base, line, texts = words(140), " ".join(words(9)), []
    for _ in range(220):
        rate, copy = rng.choice([0.004, 0.01, 0.02, 0.04]), []
        for x in base:
            u = rng.random() / rate
            copy += [x] if u >= 1 else [] if u < 0.33 else ["the"] if u < 0.66 else [f"{x}q{rng.integers(3)}"]
        texts.append(" ".join(copy))
    texts += [f"{line}\n{' '.join(words(rng.integers(1, 90)))}" for _ in range(150)]
    texts += [None, "", " ", "a", "A", "a b c", "A b  c", "", "one two three four five six", "one two three four five six seven"]
    return texts + [texts[5]] * 40 + [texts[7].upper()] * 3


def _expected(texts):
    sets = ngram_join.shingle_sets(texts)
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if len(s) and len(t):
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= 80 * (len(s) + len(t) - both):
                    a, b = root(i), root(j)
                    label[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("group", "queries", "chunk"), [(64, 256, 1 << 20), (5, 7, 2000)])
def test_families_of_edited_copies(spark, monkeypatch, group, queries, chunk):
    for name, value in (("GROUP", group), ("QUERIES", queries), ("CHUNK", chunk)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs).collect()}
    assert got == _expected(texts) and len({c for _, c in got.values()}) > 200


def test_rows_of_one_id(spark):
    texts = _texts()
    a, b, c = texts[0], texts[300], texts[310]
    rows = [(1, a), (1, b), (2, b), (3, a), (3, a), (4, None), (4, c), (None, "x y"), (5, c), (5, ""), (6, ""), (7, None)]
    found = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = {t: len(s) for t, s in zip((a, b, c, "x y"), ngram_join.shingle_sets([a, b, c, "x y"]), strict=True)}
    label = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, None: None}
    assert sorted(map(str, found)) == sorted(f"Row(doc_id={i}, n_shingles={n.get(t, 0)}, component_id={label[i]})" for i, t in rows)


def test_dealt_tokens_cannot_miss_a_link():
    """Of the tokens that two sets share in order, so many lie in the dealt parts of both, however the others are placed."""
    for m in range(1, 400):
        for n in range(ngram_join.least_partner(m), m + 1):
            overlap = -(-80 * (m + n) // 180)
            if overlap <= n:
                sure = min(min(int(ngram_join.dealt_length(x)) - (x - overlap), overlap) for x in (m, n))
                assert sure >= max(ngram_join.least_shared(m), ngram_join.least_shared(n))
