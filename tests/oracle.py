"""Runs queries beside their SQL in DuckDB and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    round_ = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(round_(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = query(spark, sf_dir)
    result = con.execute(sql)
    expected = rows_of([c[0] for c in result.description], result.fetchall())
    assert sorted(found.columns) == sorted(c[0] for c in result.description), name
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == expected, name
    return len(expected)
