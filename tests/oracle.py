"""Compare a query with its SQL on the same tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import numpy as np


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(v):
    if v is None:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    return str(v)


def rows_of(records, columns):
    return sorted(([plain(r[c]) for c in columns] for r in records), key=repr)


def assert_same(df, sql, connection):
    columns = sorted(df.columns)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = rows_of([dict(zip(names, r)) for r in result.fetchall()], columns)
    assert rows_of(df.collect(), columns) == expected
