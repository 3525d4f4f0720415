"""Rows of both engines in one comparable form."""


def plain(v):
    """A value that compares equal for both engines."""
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v if v is None or isinstance(v, bool) else str(v)


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    names = sorted(duck.sql(sql).columns)
    return sorted((tuple(plain(x) for x in r) for r in duck.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()), key=repr)
