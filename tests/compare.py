"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short account of the first difference."""
    got_c, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    res = con.execute(sql)
    want_c, want = rows_of([d[0] for d in res.description], res.fetchall())
    kinds = {d[0]: str(d[1]) for d in res.description}
    unlike = [(c, t, kinds.get(c)) for c, t in spark_df.dtypes if SQL_TYPES.get(t) != kinds.get(c)]
    if got_c == want_c and unlike:
        return f"types differ: {unlike}"
    if got_c != want_c:
        return f"columns {got_c} against {want_c}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = {(c, type(g).__name__, type(w).__name__) for gr, wr in zip(got, want)
             for c, g, w in zip(got_c, gr, wr) if g is not None and w is not None and type(g) is not type(w)}
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}"
    if types:
        return f"types differ: {sorted(types)}"
    return None
