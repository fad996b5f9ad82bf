"""A query against its SQL, whatever the order of rows."""


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def matches_sql(spark, duck, sf_dir, query, sql):
    df = query(spark, sf_dir)
    rows, names = df.collect(), df.columns
    rel = duck.sql(sql)
    assert sorted(names) == sorted(rel.columns)
    at = [names.index(c) for c in rel.columns]
    ours = sorted(repr([plain(r[i]) for i in at]) for r in rows)
    theirs = sorted(repr([plain(v) for v in r]) for r in rel.fetchall())
    assert ours == theirs
