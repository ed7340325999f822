"""Spark results against DuckDB's, as sorted rows with columns in name order."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _norm(x):
    return None if x is None else ("nan" if isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


def compare(frame, con, sql):
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    found = con.execute(sql)
    want = rows([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
