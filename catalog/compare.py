"""Run a query and its SQL over the same files and compare the rows."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def open_duckdb(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    return value


def _rows(names: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def spark_rows(df: DataFrame) -> tuple[list[str], list]:
    return _rows(df.columns, [tuple(row) for row in df.collect()])


def oracle_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list]:
    cursor = con.execute(sql)
    return _rows([column[0] for column in cursor.description], cursor.fetchall())


def difference(found: tuple[list[str], list], wanted: tuple[list[str], list]) -> str | None:
    """What differs, or None when columns and rows agree."""
    if found[0] != wanted[0]:
        return f"columns {found[0]} != {wanted[0]}"
    if found[1] == wanted[1]:
        return None
    missing, extra = [], []
    left, right = set(map(repr, found[1])), set(map(repr, wanted[1]))
    missing = sorted(right - left)[:3]
    extra = sorted(left - right)[:3]
    return f"rows {len(found[1])} vs {len(wanted[1])}; only Spark {extra}; only SQL {missing}"
