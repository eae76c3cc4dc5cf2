"""Run queries in Spark and their oracles in DuckDB and compare whole results."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        if str(a[c].dtype) != str(b[c].dtype) and {str(a[c].dtype), str(b[c].dtype)} - {"object", "str"}:
            return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same.idxmin()
            return f"{(~same).sum()} values of {c} differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


if __name__ == "__main__":
    from scanlake.session import local_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            spent = time.time() - start
            sql = oracle_sql().get(name)
            start = time.time()
            verdict = difference(got, oracle(sql, sf_dir)) if sql else "rows only"
            print(f"{'OK ' if verdict is None else '-- ' if not sql else 'BAD'} {name} rows={len(got)} {spent:.1f}s oracle={time.time()-start:.1f}s {verdict or ''}", flush=True)
            bad += bool(sql and verdict)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR {name} {type(e).__name__}: {str(e)[:700]}", flush=True)
    print("bad", bad)
