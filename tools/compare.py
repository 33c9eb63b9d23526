"""Run the registered queries on Spark and their SQL on DuckDB, report differences.

usage: python tools/compare.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from foldloom.catalog import QUERIES, SQL  # noqa: E402
from foldloom.session import build_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    return db


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.10g}"
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return f"{float(v):.10g}"
    return str(v)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, db, folder: str, name: str) -> str | None:
    """None when both sides agree (or there is no SQL), else a description."""
    df = QUERIES[name](spark, folder)
    got = df.collect()
    if name not in SQL:
        return None if got else "no rows"
    rel = db.execute(SQL[name])
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        return f"rows {len(got)} vs {len(want)}; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}"
    spark_types = {c: t for c, t in df.dtypes}
    sql_types = {d[0]: str(d[1]) for d in rel.description}
    loose = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (t, sql_types[c]) for c, t in spark_types.items() if loose.get(t, t).upper() != sql_types[c].upper()}
    return f"types {odd}" if odd else None


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:] or sorted(QUERIES)
    spark = build_session("compare", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, connect(folder), folder, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "sql" if name in SQL else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind:4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
