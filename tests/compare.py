"""Compare a Spark result with a DuckDB result as unordered sets of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if hasattr(value, "as_integer_ratio") and not isinstance(value, bool):
        return float(f"{float(value):.12g}")
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark_df, con, sql: str) -> str:
    """Empty if both hold the same rows under the same column names."""
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    expected = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    actual = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if actual == expected:
        return "" if actual else "both results are empty"
    extra, lacking = list((actual - expected).items())[:2], list((expected - actual).items())[:2]
    total = (sum(actual.values()), sum(expected.values()))
    return f"{total[0]} rows against {total[1]}; only in Spark {extra}; only in SQL {lacking}"
