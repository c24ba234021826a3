"""Compare a registered query with its SQL in DuckDB, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "item"):
        return value.item()
    return value


def _sorted(rows, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [str(v) for v in r])


def differences(spark_df, con, sql: str) -> list[str]:
    names = spark_df.columns
    got = spark_df.collect()
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(want_names):
        return [f"columns {sorted(names)} != {sorted(want_names)}"]
    left = _sorted(got, [names.index(c) for c in sorted(names)])
    right = _sorted(want, [want_names.index(c) for c in sorted(names)])
    out = []
    if len(left) != len(right):
        out.append(f"{len(left)} rows != {len(right)}")
    for a, b in zip(left, right):
        if a != b or [type(v) for v in a] != [type(v) for v in b]:
            out.append(f"{sorted(names)}\n   spark {a}\n   sql   {b}")
        if len(out) > 3:
            break
    return out
