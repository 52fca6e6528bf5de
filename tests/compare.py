"""Order-insensitive comparison of a Spark result with DuckDB's."""

import math
from collections import Counter


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in data)


def assert_same(df, duck, sql):
    got = rows(df.columns, df.collect())
    res = duck.execute(sql)
    want = rows([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0]
    extra, missing = got[1] - want[1], want[1] - got[1]
    assert not extra and not missing, (list(extra.items())[:3], list(missing.items())[:3], sum(got[1].values()), sum(want[1].values()))
    assert sum(got[1].values()) > 0
