"""Compare registered queries with their SQL; also usable from the command line."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time() else value
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def _canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def difference(spark_df, con, sql: str) -> str | None:
    """None if equal, else a description of the first difference."""
    rel = con.execute(sql)
    want_cols, want = _canon([c[0] for c in rel.description], rel.fetchall())
    got_cols, got = _canon(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            bad = [(c, x, y) for c, x, y in zip(got_cols, g, w) if x != y or type(x) is not type(y)]
            return f"first difference {bad[:4]} in {g[:4]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from riskweave.session import local_session

    sf_dir = sys.argv[1]
    only = set(sys.argv[2:])
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in sql:
                result = difference(query(spark, sf_dir), con, sql[name]) or "equal"
            else:
                result = f"no SQL, rows {len(query(spark, sf_dir).collect())}"
        except Exception as e:  # noqa: BLE001
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:28s} {time.time() - start:6.2f}s  {result}", flush=True)


if __name__ == "__main__":
    main()
