"""Compare a registered query with its SQL oracle, order-insensitively."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, float):
        if math.isnan(value):
            return (2, "nan")
        return (1, f"{value:.9g}")
    if isinstance(value, int):
        return (1, f"{float(value):.9g}")
    return (1, str(value))


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


SPARK_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def differences(df, connection, sql: str) -> list[str]:
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = dict(zip(names, [str(d[1]) for d in result.description]))
    expected = normalise(names, result.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    relation = connection.sql(sql)
    types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    for name, kind in df.dtypes:
        if SPARK_TYPES.get(kind) != types[name]:
            problems.append(f"type of {name}: {kind} vs {types[name]}")
    actual = normalise(df.columns, [tuple(r) for r in df.collect()])
    if len(actual) != len(expected):
        problems.append(f"rows {len(actual)} != {len(expected)}")
    elif actual != expected:
        wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
        problems.append(f"{len(wrong)} rows differ, first {wrong[0]}")
    return problems
