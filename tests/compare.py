"""Run catalog queries in Spark and in DuckDB and compare their rows.

    python tests/compare.py [sf folder] [query ...]
"""

from __future__ import annotations

import math
import signal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck_connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple((v is None, str(type(v)), str(v)) for v in t))


def differences(spark_df, con, sql: str) -> list[str]:
    got = rows_of(spark_df.columns, spark_df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    want = rows_of(names, result.fetchall())
    out = []
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(names)}"]
    spark_kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR",
                   "boolean": "BOOLEAN", "double": "DOUBLE"}
    for name, kind in spark_df.dtypes:
        if spark_kinds.get(kind, kind) != kinds[name]:
            out.append(f"type of {name}: {kind} vs {kinds[name]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} vs {len(want)}")
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        out.append(f"{len(a)} rows only in Spark, {len(b)} only in DuckDB")
        out.extend(f"  spark {sorted(a, key=str)[i]}" for i in range(min(3, len(a))))
        out.extend(f"  duck  {sorted(b, key=str)[i]}" for i in range(min(3, len(b))))
    if not want:
        out.append("no rows to compare")
    return out


def _late(*_):
    raise TimeoutError("took too long")


def main() -> None:
    import __spark_entry__ as entry
    from jobsluice.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    chosen = sys.argv[2:]
    spark, con = local_session(), duck_connection(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in chosen or queries:
        start = time.time()
        signal.signal(signal.SIGALRM, _late)
        signal.alarm(150)
        try:
            if name in oracles:
                out = differences(queries[name](spark, folder), con, oracles[name])
            else:
                n = len(queries[name](spark, folder).collect())
                out = [] if n else ["no rows"]
                name += f" (rows only: {n})"
        except Exception as error:  # noqa: BLE001 - report every query
            out = [f"{type(error).__name__}: {str(error)[:700]}"]
        signal.alarm(0)
        bad += bool(out)
        print(f"{'ok  ' if not out else 'FAIL'} {name} {time.time() - start:.1f}s", flush=True)
        for line in out:
            print("     ", line[:900], flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
