"""Compare a registered query with its oracle on one data directory."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(value):
    if value is None:
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat(sep=" ")
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_value(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(con, text: str):
    relation = con.sql(text)
    columns = sorted(relation.columns)
    order = [relation.columns.index(c) for c in columns]
    return columns, sorted((tuple(_value(r[i]) for i in order) for r in relation.fetchall()), key=repr)


def difference(df, con, text: str) -> str:
    """Empty if both results are equal, else a short description."""
    left_columns, left = spark_rows(df)
    right_columns, right = duck_rows(con, text)
    if left_columns != right_columns:
        return f"columns {left_columns} != {right_columns}"
    if left != right:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        return f"{len(left)} rows and {len(right)} rows; spark only {only_left}; oracle only {only_right}"
    types = dict(df.dtypes)
    wrong = {c: t for c, t in types.items() if t not in ("bigint", "string", "boolean", "timestamp", "timestamp_ntz", "double")}
    return f"types {wrong}" if wrong else ""
