"""Time-ordered target encoding against a plain loop: ties in time, hot keys cut into chunks, nulls, repeats, unknown ids."""

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from quadrille.llm import encoding
from quadrille.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import assert_same, connect

LINES = "sale_id long, line_no int, item_id long, vendor_id long, flag string, time int, n int, fold string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, kind string, all_rate int"
START = datetime(2024, 1, 1)


def plain(lines, sales, items, vendors, clients):
    at = {s: (c if c is not None else -1, t) for s, c, t in sales if s is not None and t is not None}
    rows = []
    for s, i, v, flag in lines:
        if s in at:
            c, t = at[s]
            i = -1 if i is None else i
            rows.append({"sale": s, "item": i, "vendor": v, "client": c, "t": t, "fold": zlib.crc32(str(s).encode()) % 5, "back": flag == "returned", "all": 0, "kind": items.get(i), "nation": vendors.get(v), "segment": clients.get(c)})
    names = ("all", "kind", "nation", "segment", "item", "vendor", "client")
    by_time, seen, out = defaultdict(list), {n: defaultdict(lambda: [[0, 0] for _ in range(5)]) for n in names}, {}
    for r in rows:
        by_time[r["t"]].append(r)

    def rate(n, s, p):
        return p if n < 1 else (1000000 * s + 50 * p) // (n + 50)

    for t in sorted(by_time):
        for r in by_time[t]:
            h = {n: [sum(x[k] for f, x in enumerate(seen[n][r[n]]) if f != r["fold"]) for k in (0, 1)] for n in names}
            base = rate(*h["all"], 500000)
            said = []
            for n, up in (("item", "kind"), ("vendor", "nation"), ("client", "segment")):
                said += [h[n][0], rate(*h[n], rate(*h[up], base))]
            key = r["sale"], r["item"], r["vendor"]
            own = out.setdefault(key, [0, 0, *said])
            own[0] += 1
            own[1] += r["back"]
        for r in by_time[t]:
            for n in names:
                seen[n][r[n]][r["fold"]][0] += 1
                seen[n][r[n]][r["fold"]][1] += r["back"]
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def shop(rng, n_sales, hot):
    """Sales with repeated times; ``hot`` of all rows have one client, item, vendor and moment."""
    pick = lambda m: 1 if rng.random() < hot else rng.choice([None, *range(m)])
    sales = [(s, pick(12), rng.choice([None, START]) if rng.random() < 0.05 else START + timedelta(seconds=7 if rng.random() < hot else rng.randrange(90), microseconds=rng.choice([0, 0, 1]))) for s in range(n_sales)]
    lines = [(1 if rng.random() < hot else rng.choice([None, rng.randrange(n_sales + 5)]) if rng.random() < 0.1 else rng.randrange(n_sales), pick(9), pick(6) if rng.random() < 0.9 else None, rng.choice(["returned", "kept", None, "swapped"])) for _ in range(n_sales * 4)]
    return lines + lines[:20], sales, {i: rng.choice("xyz") if i % 4 else None for i in range(7)}, {v: v % 3 for v in range(5)}, {c: rng.choice(["s", "t", None]) for c in range(9)}


def frames(spark, lines, sales, items, vendors, clients):
    return (
        spark.createDataFrame([(s, 0, i, v, f, 1, 2, "x") for s, i, v, f in lines], LINES).repartition(3), spark.createDataFrame([(*s, "k", 0) for s in sales], SALES),
        spark.createDataFrame([(*x, "time") for x in items.items()] + [(None, "q", "w")], "item_id long, kind string, time string"),
        spark.createDataFrame(list(vendors.items()), "vendor_id long, nation_id int"), spark.createDataFrame([(*x, 4) for x in clients.items()], "client_id long, segment string, n int"),
    )


@pytest.mark.parametrize(("n_sales", "hot"), [(60, 0.0), (400, 0.4)])
def test_against_a_plain_loop(spark, n_sales, hot):
    data = shop(random.Random(n_sales), n_sales, hot)
    got = encoding.sale_lines_encoded(*frames(spark, *data))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(*data)


def test_hot_keys_are_cut(spark):
    """With a low share a key of most rows lies in many chunks, and one moment in several."""
    rng = random.Random(4)
    rows = [(i, rng.choice([5, 5, 5, None, 6]), rng.choice([40, 40, rng.randrange(80)]), rng.randrange(5), 1 + i % 2, i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, key long, time long, fold int, n int, s int").repartition(3)
    got = encoding.key_history(df, "key", "k", encoding.F.xxhash64("id"))
    pieces = {}
    for i, k, t, f, *_ in rows:
        before = [(n, s) for _, k2, t2, f2, n, s in rows if k2 == k and t2 < t and f2 != f] if i % 37 == 0 else None
        pieces[i] = None if before is None else (sum(n for n, _ in before), sum(s for _, s in before))
    found = {r["id"]: (r["k_n"], r["k_s"]) for r in got.collect()}
    assert len(found) == 3000 and all(found[i] == w for i, w in pieces.items() if w is not None)
    wide = encoding.column_histories(df, ["key"], encoding.F.xxhash64("id")).where("id % 37 = 0").collect()
    for r in wide:
        before = [(k2, n) for _, k2, t2, f2, n, _ in rows if t2 < r["time"] and f2 != r["fold"]]
        assert r["all_n"] == sum(n for _, n in before) and r["key_n"] == sum(n for k2, n in before if k2 == r["key"])


def test_repeated_sales_and_empty_tables(spark):
    data = shop(random.Random(8), 20, 0.0)
    lines, sales, items, vendors, clients = frames(spark, *data)
    once = encoding.sale_lines_encoded(lines, sales, items, vendors, clients).agg(encoding.F.sum("n_lines")).first()[0]
    twice = encoding.sale_lines_encoded(lines, sales.union(sales), items, vendors, clients).agg(encoding.F.sum("n_lines")).first()[0]
    assert twice == 2 * once
    assert encoding.sale_lines_encoded(lines.limit(0), sales, items, vendors, clients).collect() == []
    assert encoding.sale_lines_encoded(lines, sales.limit(0), items, vendors, clients).collect() == []
    alone = encoding.sale_lines_encoded(lines, sales, items.limit(0), vendors.limit(0), clients.limit(0))
    assert alone.agg(encoding.F.sum("n_lines")).first()[0] == once


def test_query_agrees_with_sql(spark, sf_dir):
    assert assert_same(QUERIES["op13_target_encoding"](spark, sf_dir), connect(sf_dir), ORACLE_SQL["op13_target_encoding"]) > 0
