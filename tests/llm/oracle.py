"""Runs a query and its DuckDB SQL over one folder of tables and compares all rows as strings."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    out = con.sql(sql).to_arrow_table()
    return out.column_names, out.to_pylist()


def norm(rows, names):
    def one(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        return str(v)

    return sorted(tuple(one(r[c]) for c in sorted(names)) for r in rows)


def same(spark, f, sql, sf_dir):
    df = f(spark, sf_dir)
    names, rows = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = norm([r.asDict(recursive=True) for r in df.collect()], names)
    want = norm(rows, names)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not bad, bad[:3]
