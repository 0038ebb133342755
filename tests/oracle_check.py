"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return repr(v)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


# Spark type name of each DuckDB type that the checks use.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
         "BOOLEAN": "boolean"}


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got, got_cols = as_rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want, want_cols = as_rows(cols, res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    for name, spark_type in df.dtypes:
        if TYPES.get(types[name], types[name]) != spark_type:
            return f"type of {name}: {spark_type} != {types[name]}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            n = sum(1 for a, b in zip(got, want) if a != b)
            return f"{n} rows differ, first {g} != {w} for {got_cols}"
    return None


def main() -> None:
    from compscope.queries import ORACLES, QUERIES
    from compscope.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = args or list(QUERIES)
    spark, con = local_session(8), connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf)
            built = time.time() - start
            if name in ORACLES:
                diff = compare(df, con, ORACLES[name])
                status = "ok" if diff is None else f"DIFF {diff}"
            else:
                status = f"rows {df.count()}"
        except Exception as e:  # noqa: BLE001
            status, built = f"ERROR {type(e).__name__} {str(e)[:1500]}", 0
        bad += not status.startswith(("ok", "rows"))
        print(f"{name:28s} {time.time() - start:6.1f}s (build {built:.1f}) {status[:1600]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
