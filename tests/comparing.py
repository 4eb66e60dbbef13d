"""A query's rows and its SQL's rows in one form."""

import duckdb

from fabula.plans import catalog


def _plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 5)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return str(x)


def query_and_oracle(spark, folder, name, tables=("documents",)):
    """Sorted rows, columns by name, of a registered query and of its SQL over the Parquet folders of `folder`."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = catalog.queries()[name](spark, folder)
    names = sorted(df.columns)
    got = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    found = con.execute(catalog.oracles()[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    want = [tuple(_plain(r[at.index(c)]) for c in names) for r in found.fetchall()]
    return sorted(got, key=str), sorted(want, key=str)
