"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "∅"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, float):
        return repr(float(value))
    return str(value)


def kind(name: str) -> str:
    name = name.lower()
    for family, words in {
        "int": ("bigint", "int", "integer", "long", "hugeint", "smallint"),
        "float": ("double", "float"),
        "str": ("string", "varchar"),
        "bool": ("boolean",),
        "ts": ("timestamp",),
    }.items():
        if any(name.startswith(w) for w in words):
            return family
    return name


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when both sides hold the same columns, types and rows."""
    problems = []
    rel = con.sql(sql)
    ours = {c: kind(t) for c, t in spark_df.dtypes}
    theirs = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    if ours != theirs:
        return [f"schema: spark {ours} duckdb {theirs}"]
    exact = {c: t for c, t in spark_df.dtypes if t in ("int", "bigint")}
    for c, t in zip(rel.columns, rel.types):
        if c in exact and {"int": "INTEGER", "bigint": "BIGINT"}[exact[c]] != str(t):
            problems.append(f"width of {c}: spark {exact[c]} duckdb {t}")
    columns = sorted(ours)
    left = sorted(tuple(_cell(row[c]) for c in columns) for row in spark_df.collect())
    at = [rel.columns.index(c) for c in columns]
    right = sorted(tuple(_cell(row[i]) for i in at) for row in rel.fetchall())
    if len(left) != len(right):
        problems.append(f"rows: spark {len(left)} duckdb {len(right)}")
    if left != right:
        only = [x for x in left if x not in set(right)][:3]
        lost = [x for x in right if x not in set(left)][:3]
        problems.append(f"{columns}: only spark {only} only duckdb {lost}")
    return problems
