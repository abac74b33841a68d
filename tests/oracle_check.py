"""Run a registered query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
import pathlib
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value if value is None or isinstance(value, (str, int)) else str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    table = [tuple(plain(row[i]) for i in order) for row in values]
    return [columns[i].lower() for i in order], sorted(table, key=repr)


def compare(spark, root, db, fn, sql):
    """None if equal, else what differs."""
    df = fn(spark, root)
    left = rows(df.columns, [tuple(x) for x in df.collect()])
    cursor = db.execute(sql)
    right = rows([c[0] for c in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {sorted(set(left[0]) ^ set(right[0]))}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} vs {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return str([(c, x, y) for c, x, y in zip(left[0], a, b) if x != y][:6])
    types = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    names = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean",
             "TIMESTAMP": "timestamp_ntz"}
    for column in cursor.description:
        kind = names.get(str(column[1]), str(column[1]))
        if kind != types[column[0].lower()]:
            return f"type of {column[0]}: {types[column[0].lower()]} vs {kind}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(pathlib.Path(__file__).parents[1]))
    import __spark_entry__ as entry
    from conversion_engine.session import local_session

    root = f"/root/testdata/{sys.argv[1]}"
    spark = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(root)
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, root, db, fn, oracles[name])
                print("##", "OK  " if result is None else "DIFF", name, round(time.time() - start, 1), result or "", flush=True)
            else:
                print("## ROWS", name, fn(spark, root).count(), round(time.time() - start, 1), flush=True)
        except Exception as error:  # keep going: this is a report
            print("## FAIL", name, type(error).__name__, str(error)[:400].replace("\n", " "), flush=True)
