"""Comparison of queries with their SQL, shared by the test modules."""

import glob
import os
from collections import Counter

import duckdb


def database(data):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return connection


def rows(table):
    names = sorted(table.column_names)
    return names, Counter(tuple(str(row[name]) for name in names) for row in table.to_pylist())


def assert_same(spark, data, query, sql):
    assert rows(query(spark, data).toArrow()) == rows(database(data).execute(sql).to_arrow_table())
