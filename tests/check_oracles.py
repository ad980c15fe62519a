"""Compare registered queries with their SQL in DuckDB: python tests/check_oracles.py DIR [names]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from corpusmill.session import local_session  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value


def compare(spark, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    frame = queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    mine = sorted((tuple(normal(r[c]) for c in columns) for r in frame.collect()), key=repr)
    spent = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return bool(mine), f"{len(mine)} rows, no SQL, {spent:.1f}s"
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    started = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    at = [names.index(c) for c in columns] if sorted(names) == columns else None
    if at is None:
        return False, f"columns {columns} and {sorted(names)}"
    theirs = sorted((tuple(normal(r[i]) for i in at) for r in result.fetchall()), key=repr)
    note = f"{len(mine)} rows, {spent:.1f}s, SQL {time.time() - started:.1f}s"
    if mine != theirs:
        first = next(((a, b) for a, b in zip(mine, theirs) if a != b), None)
        return False, f"{note}; {len(theirs)} expected, first difference {first}"
    return True, note


if __name__ == "__main__":
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for query_name in sys.argv[2:] or queries():
        try:
            fine, text = compare(session, sys.argv[1], query_name)
        except Exception as error:  # report and go on with the next query
            fine, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not fine
        print("ok  " if fine else "FAIL", query_name, text, flush=True)
    print(f"{bad} failed")
