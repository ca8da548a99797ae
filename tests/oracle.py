"""Run registered queries beside their SQL and compare the results."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_" or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        f = float(v)
        return f"{f:.6f}" if f == f else ""
    try:
        f = float(v) if type(v).__name__ == "Decimal" else None
        if f is not None:
            return f"{f:.6f}"
    except (TypeError, ValueError):
        pass
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(_cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    a, b = rows(spark_df), rows(sql_df)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(spark_df.columns)}\n   spark {x}\n   sql   {y}"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from vigilframe.catalog import QUERIES, SQL, load
    from vigilframe.session import local_session

    sf_dir = argv[0]
    wanted = argv[1:]
    load()
    spark = local_session()
    con = connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERR  {name}: {str(e)[:1200]}", flush=True)
            continue
        dt = time.time() - t0
        if name not in SQL:
            print(f"rows {name} {len(got)} {dt:.1f}s (no SQL)", flush=True)
            continue
        try:
            exp = con.execute(SQL[name]).df()
        except Exception as e:
            bad += 1
            print(f"SQLERR {name}: {str(e)[:600]}", flush=True)
            continue
        diff = compare(got, exp)
        bad += diff is not None
        print(f"{'OK  ' if diff is None else 'DIFF'} {name} {len(got)} {dt:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
