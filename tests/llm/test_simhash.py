"""SimHash against pure Python: fingerprints, bit planes, links at every group size, components."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quadrille.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int, mask long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    found = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not found:
        return 0
    grams = [" ".join(found[i : i + 3]) for i in range(max(len(found) - 2, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, radius):
    """The smallest id reachable from each fingerprint (ids by fingerprint), by comparing all pairs."""
    fps = sorted(nodes)
    lead = {f: f for f in fps}

    def root(f):
        while lead[f] != f:
            lead[f] = lead[lead[f]]
            f = lead[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                lead[root(a)] = root(b)
    least = defaultdict(list)
    for f in fps:
        least[root(f)] += [i for i in nodes[f] if i is not None]
    return {f: min(least[root(f)], default=None) for f in fps}


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(300)]
    out = [None, "", " \t\n", "One", "one two", "ONE two Three", "日本 語 €", "a " * 400, " ".join(base)]
    for n in (1, 1, 2, 3, 5, 8, 20):
        copy = list(base)
        for _ in range(n):
            copy[rng.randrange(300)] = word()
        out.append(" ".join(copy))
    out += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(40)]
    out.append(" ".join(word() for _ in range(70_000)))  # longer than a piece
    return out + out[:12]


def test_documents_against_pure_python(spark):
    rows = [(i, t, "x", -1, 7) for i, t in enumerate(texts())] + [(None, "One", "x", 0, 0), (3, "one  two", None, None, None)]
    nodes = defaultdict(list)
    for i, t, *_ in rows:
        nodes[plain_fingerprint(t)].append(i)
    want = plain_components(nodes, 2)
    got = simhash.similar_fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    mine = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str)
    assert mine == sorted(((i, f"{plain_fingerprint(t):016x}", want[plain_fingerprint(t)]) for i, t, *_ in rows), key=str)


def test_an_empty_table(spark):
    assert simhash.similar_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_planes(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(0, 300, 3):  # near others
        f[i] = f[(i + 1) % 300] ^ np.uint64(1 << int(rng.integers(0, 64))) ^ np.uint64(1 << int(rng.integers(0, 64)))
    ends = np.repeat([70, 71, 200, 300], [70, 1, 129, 100])
    i, j = simhash.near_lanes(f, ends, list(range(64)), radius)
    want = {(a, b) for a in range(300) for b in range(a + 1, ends[a]) if (int(f[a]) ^ int(f[b])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_masks_keep_every_near_pair():
    rng = random.Random(2)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        masks = [m for m in simhash.group_masks(2) if a & m == b & m]
        assert masks
        for _ in range(4):
            masks = [n for m in masks for n in simhash.finer_masks(m, 2) if a & n == b & n] if any(64 - m.bit_count() > 2 for m in masks) else masks
            assert masks


@pytest.mark.parametrize("limit", [8, 1024])
def test_a_dense_cloud_with_groups_of_every_size(spark, limit):
    """Hundreds of fingerprints around a few, so that groups pass a small limit again and again."""
    rng = random.Random(9)
    nodes = defaultdict(list)
    for c in range(4):
        at = rng.getrandbits(64)
        for _ in range(150):
            at ^= sum({1 << rng.randrange(64 if c else 12) for _ in range(rng.randint(0, 3))})
            nodes[at].append(len(nodes))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in nodes]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 2, limit).collect()
    lead = {f: f for (f,) in signed}
    for r in edges:
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() > 0

    def root(f):
        while lead[f] != f:
            f = lead[f]
        return f

    for r in edges:
        lead[root(r["a"])] = root(r["b"])
    mine, want = defaultdict(set), defaultdict(set)
    for f in nodes:
        mine[root(f - (1 << 64) if f >> 63 else f)].add(f)
    for f, least in plain_components(nodes, 2).items():
        want[least].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
