"""Comparing a catalogue query with its SQL in DuckDB."""

from __future__ import annotations

import math
import time

import duckdb

from bagtree.catalog.registry import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else round(value, 6) + 0.0
        return value

    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, sf_dir: str, name: str, sql: str | None, run=None) -> tuple[str, float]:
    start = time.time()
    frame = (run or QUERIES[name])(spark, sf_dir)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    seconds = time.time() - start
    if sql is None:
        return f"rows only: {len(mine)}", seconds
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = db.execute(sql)
    columns = [c[0] for c in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS DIFFER {sorted(frame.columns)} {sorted(columns)}", seconds
    if mine == theirs:
        return f"ok {len(mine)} rows", seconds
    different = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"ROWS DIFFER {len(mine)} {len(theirs)} first {different[:2]}", seconds
