"""Compare every ``queries()`` entry with its ``oracle_sql()`` entry (DuckDB), as the driver does.

Usage: ``python tests/oracle_compare.py [sf_dir] [key ...]``.  Prints one line per
key and exits non-zero when any key differs.
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

import duckdb
import pandas as pd

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm_value(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and pd.isna(v)):
        return "NULL"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def frame_digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("\x1f".join(_norm_value(v) for v in r) for r in df[cols].itertuples(index=False, name=None))
    h = hashlib.sha256("\x1e".join(rows).encode()).hexdigest()
    return len(df), cols, h


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, keys: list[str] | None = None, verbose: bool = True) -> dict[str, dict]:
    import __spark_entry__ as E

    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for k in keys or sorted(qs):
        rec: dict = {"key": k}
        t0 = time.time()
        try:
            sdf = qs[k](spark, sf_dir).toPandas()
            rec["spark_s"] = round(time.time() - t0, 2)
            if k not in os_:
                rec.update(status="no-oracle", rows=len(sdf))
            else:
                odf = con.execute(os_[k]).df()
                a, b = frame_digest(sdf), frame_digest(odf)
                rec.update(rows=(a[0], b[0]), cols_equal=a[1] == b[1], hash_equal=a[2] == b[2])
                rec["status"] = "match" if (a[0] == b[0] and a[1] == b[1] and a[2] == b[2]) else "MISMATCH"
                if rec["status"] != "match":
                    rec["spark_cols"], rec["oracle_cols"] = a[1], b[1]
                    rec["_frames"] = (sdf, odf)
        except Exception as exc:  # report and continue
            rec.update(status="ERROR", error=f"{type(exc).__name__}: {str(exc)[:400]}")
        out[k] = rec
        if verbose:
            print({x: y for x, y in rec.items() if not x.startswith("_")}, flush=True)
    return out


def main() -> int:
    from precursor.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = local_session(8)
    res = compare(spark, sf_dir, keys)
    bad = [k for k, r in res.items() if r["status"] not in ("match", "no-oracle")]
    print(f"{len(res) - len(bad)}/{len(res)} ok; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
