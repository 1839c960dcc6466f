"""A query against its SQL, as rows of plain values with six digits."""

import decimal
import glob
import math

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return plain(tuple(v)) if hasattr(v, "asDict") else v


def check(spark, query, sql=None):
    """The query runs; with SQL its rows and columns are those of the SQL."""
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if sql is None:
        return
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    cur = db.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert got == sorted(str(tuple(plain(r[names.index(c)]) for c in cols)) for r in cur.fetchall())
