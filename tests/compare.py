"""Rows of a Spark frame and of a DuckDB query as comparable text."""

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(v):
    if isinstance(v, pd.Timestamp):
        return None if v is pd.NaT else str(v)
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "__len__") and not isinstance(v, str):
        return tuple(_plain(x) for x in v)
    return v.item() if hasattr(v, "item") else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    # whole numbers with nulls: one side has pandas' own type, the other doubles
    frame = frame.astype({c: "float64" for c, t in frame.dtypes.items() if pd.api.types.is_extension_array_dtype(t) and pd.api.types.is_integer_dtype(t)})
    return list(frame.columns), sorted(repr(tuple(map(_plain, r))) for r in frame.itertuples(index=False, name=None))
