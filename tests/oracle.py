"""Compare a registered query with its SQL on the driver's tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def same(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty if both have the same columns and rows, in any order; else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    cols = sorted(got.columns)
    a, b = (x[cols].copy() for x in (got, want))
    for c in cols:
        for x in (a, b):
            x[c] = x[c].map(lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    a, b = (x.sort_values(cols).reset_index(drop=True) for x in (a, b))
    bad = (a != b).any(axis=1)
    return f"{int(bad.sum())} rows differ, as {a[bad].head(2).to_dict('records')} and {b[bad].head(2).to_dict('records')}" if bad.any() else ""
