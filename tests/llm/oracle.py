"""Compares a Spark result with DuckDB's on the same parquet tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame, names):
    def norm(v):
        if isinstance(v, float):
            return round(v, 6)
        return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v

    return sorted((tuple(norm(v) for v in r) for r in frame), key=repr)


def check(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    names = sorted(got.columns)
    expect = con.execute(f"select {', '.join(names)} from ({sql})").fetchall()
    assert rows_of([tuple(r) for r in got.select(names).collect()], names) == rows_of(expect, names)
    return len(expect)
