"""Rows of a query and of its SQL, for comparison."""

import duckdb

from bandloom.llm.queries import QUERIES
from bandloom.llm.sql import ORACLE_SQL


def sql_rows(name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        con.register(table, frame.toArrow())
    found = con.sql(ORACLE_SQL[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted([tuple(r[i] for i in order) for r in found.fetchall()], key=repr)


def query_rows(name, spark, folder, **tables):
    for table, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    found = QUERIES[name](spark, str(folder))
    return sorted([tuple(r[c] for c in sorted(found.columns)) for r in found.collect()], key=repr)
