"""Compare registered queries with their SQL twins; also runnable as a script.

    python tests/parity.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def difference(spark_df, con, sql: str) -> str | None:
    """None if the results agree: columns, row count, values."""
    got = canonical(spark_df.toPandas())
    want = canonical(con.execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for c in got.columns:
        a, b = got[c], want[c]
        if a.dtype != b.dtype:
            kinds = {a.dtype.kind, b.dtype.kind}
            if kinds <= {"M"} or kinds <= {"i", "u"} or kinds <= {"O", "M"} or kinds <= {"O", "T", "U"}:
                pass
            elif not (str(a.dtype).startswith("str") or str(b.dtype).startswith("str")):
                return f"column {c}: type {a.dtype} != {b.dtype}"
        if "M" in (a.dtype.kind, b.dtype.kind):
            a, b = pd.to_datetime(a), pd.to_datetime(b)
            same = (a.astype("datetime64[us]") == b.astype("datetime64[us]")) | (a.isna() & b.isna())
        else:
            same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = same[~same].index[0]
            return f"column {c}: {int((~same).sum())} differ, first {a[at]!r} != {b[at]!r}"
    return None


def main() -> None:
    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry
    from modelwatch.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("parity", "local[8]", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                state = "ok" if problem is None else f"DIFF {problem}"
            else:
                state = f"rows {df.count()}"
        except Exception as e:  # report and go on with the next query
            state = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        bad += state.startswith(("DIFF", "ERROR"))
        print(f"{name:28s} {time.time() - start:6.2f}s  {state}", flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")


if __name__ == "__main__":
    main()
