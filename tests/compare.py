"""Compares every query that has SQL with DuckDB on the same tables; prints one line for each."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chat_events sessions raw_records quarantine blob_texts blob_refs eval_items mix_targets source_zones".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, pd.Timestamp):
            return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
        if isinstance(v, float):
            return int(v) if v == int(v) else round(v, 9)
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(map(cell, row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty when both hold the same rows, else what differs."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    a, b = canonical(spark_df), canonical(sql_df)
    if a == b:
        return ""
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    return f"rows {len(a)} / {len(b)}; only ours {sorted(only_a, key=repr)[:2]}; only SQL {sorted(only_b, key=repr)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    from talkloom.session import local_session

    spark = local_session(8)
    folder = sys.argv[1]
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            ours = queries[name](spark, folder).toPandas()
            took = time.time() - began
            if name in oracles:
                why = compare(ours, con.execute(oracles[name]).df())
                print(f"{'ok  ' if not why else 'DIFF'} {name} {len(ours)} rows {took:.1f} s {time.time() - began - took:.1f} s SQL {why[:700]}", flush=True)
            else:
                print(f"rows {name} {len(ours)} {took:.1f} s", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"FAIL {name} {str(error)[:500]}", flush=True)
