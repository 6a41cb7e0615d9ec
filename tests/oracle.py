"""Run registered queries next to their SQL and compare rows, columns and values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else value
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    rows = [tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    return columns, dict(df.dtypes), rows


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]).lower() for d in result.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    return sorted(names), types, rows


SAME_TYPE = {"bigint": "bigint", "int": "integer", "double": "double", "string": "varchar", "boolean": "boolean"}


def difference(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    columns, types, rows = spark_rows(df)
    want_columns, want_types, want = duck_rows(con, sql)
    if columns != want_columns:
        return f"columns {columns} against {want_columns}"
    odd = {c: (types[c], want_types[c]) for c in columns if SAME_TYPE.get(types[c]) != want_types[c]}
    if odd:
        return f"types {odd}"
    if len(rows) != len(want):
        return f"{len(rows)} rows against {len(want)}"
    order = lambda r: tuple((v is None, str(v)) for v in r)
    rows, want = sorted(rows, key=order), sorted(want, key=order)
    wrong = [(a, b) for a, b in zip(rows, want) if a != b]
    return f"{len(wrong)} of {len(rows)} rows differ, first {str(wrong[0])[:600]}" if wrong else None


def main(names: list[str], folder: str = "/root/testdata/sf0.01") -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from ratelab.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = E.oracle_sql()
    bad = 0
    for name, build in E.queries().items():
        if names and name not in names:
            continue
        at = time.time()
        try:
            df = build(spark, folder)
            if name in sql:
                problem = difference(df, con, sql[name])
                note = "same" if problem is None else f"DIFFERS: {problem}"
            else:
                problem, note = None, f"rows only: {df.count()}"
        except Exception as error:
            problem = note = f"ERROR: {str(error)[:900]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - at:6.1f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
