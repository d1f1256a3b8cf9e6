"""Hold a query's rows against its oracle SQL, without regard to order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = round(float(v), 6)
        return int(v) if v.is_integer() else v  # pandas holds integers with nulls as doubles
    return int(v) if hasattr(v, "__index__") else v


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(map(_plain, r))) for r in frame.itertuples(index=False, name=None))


def oracle(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()
