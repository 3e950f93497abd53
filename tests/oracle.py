"""Compare registered queries with their SQL on DuckDB.  Usage: python tests/oracle.py DIR [names...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


TYPES = {"int32": "INTEGER", "int64": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "bool": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def normalized(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, query, sql: str | None) -> str:
    """'' when equal, otherwise what differs."""
    table = query(spark, sf_dir).toArrow()
    got = [tuple(r.values()) for r in table.to_pylist()]
    if sql is None:
        return "" if got else "no rows"
    cursor = con.execute(sql)
    names, want = [c[0] for c in cursor.description], cursor.fetchall()
    if sorted(table.column_names) != sorted(names):
        return f"columns {sorted(table.column_names)} / {sorted(names)}"
    spark_types = {n: TYPES.get(str(t), str(t)) for n, t in zip(table.column_names, table.schema.types)}
    sql_types = {c[0]: str(c[1]) for c in cursor.description}
    if spark_types != sql_types:
        return f"types {spark_types} / {sql_types}"
    a, b = normalized(table.column_names, got), normalized(names, want)
    if a == b:
        return "" if a else "no rows"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"rows {len(a)} / {len(b)}; only spark {len(only_a)}: {only_a[:2]}; only sql {len(only_b)}: {only_b[:2]}"


if __name__ == "__main__":
    from conftest import make_session

    from corvane.plans.catalog import load

    directory, names = sys.argv[1], sys.argv[2:]
    session, connection = make_session(), connect(sys.argv[1])
    bad = 0
    for name, (query, sql) in load().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            problem = compare(session, connection, directory, query, sql)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok'} {name} {time.time() - start:.1f}s {problem[:2500]}", flush=True)
    print(f"{bad} failed")
    session.stop()
