"""Compare a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x != x:
        return "null"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(float(r[i]) if hasattr(r[i], "as_tuple") else r[i]) for i in order) for r in data)


def assert_same(df, con, sql):
    got = df.collect()
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in got]) == rows(rel.columns, rel.fetchall())
    return len(got)
