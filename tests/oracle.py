"""Compares a registered query with its DuckDB SQL on the same tables."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if isinstance(v, (datetime.datetime, datetime.date)) else v


def compare(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    names = sorted(got.columns)
    quoted = ", ".join(f'"{n}"' for n in names)
    found = con.execute(f"select {quoted} from ({sql})")
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    expect = sorted([tuple(map(norm, r)) for r in found.fetchall()], key=key)
    mine = sorted([tuple(map(norm, r)) for r in got.select(*[f"`{n}`" for n in names]).collect()], key=key)
    assert len(mine) == len(expect), f"{len(mine)} rows, the oracle has {len(expect)}"
    for a, b in zip(mine, expect, strict=True):
        assert a == b, f"{names}: {a} is not {b}"
    return len(mine)
