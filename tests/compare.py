"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, bool):
        return value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)[:19]
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    return value


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    return normal([d[0] for d in cursor.description], cursor.fetchall())


def difference(left, right) -> str | None:
    """A short description of how two results differ; None when they agree."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    for a, b in zip(left[1], right[1], strict=True):
        if a != b:
            same = len(a) == len(b) and all(
                x == y
                or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-6))
                for x, y in zip(a, b, strict=True)
            )
            if not same:
                return f"{str(a)[:400]}\n    != {str(b)[:400]}"
    return None


def main(folder: str, names: list[str]) -> None:
    import __spark_entry__ as entry
    from lodestone.session import local_session

    spark = local_session(8)
    con = database(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = []
    for name, query in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        started = time.time()
        try:
            got = spark_rows(query(spark, folder))
            took = time.time() - started
            if name in oracle:
                problem = difference(got, sql_rows(con, oracle[name]))
                status = "OK" if problem is None else f"DIFF {problem}"
            else:
                status = "rows only"
            print(f"{name:32s} {took:6.2f}s {len(got[1]):7d} {status}", flush=True)
            if status.startswith("DIFF"):
                failed.append(name)
        except Exception as error:
            failed.append(name)
            print(f"{name:32s} ERROR {type(error).__name__} {str(error)[:900]}", flush=True)
    print("FAILED", failed)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
