"""Comparison of a query with its SQL."""


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    return v


def compare(spark, duck, data, query, sql):
    """Both results as sorted lists of rows, columns by name."""
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(norm(r[i]) for i in at)) for r in cur.fetchall())
    assert got == want
    return len(got)
