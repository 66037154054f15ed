"""Rows as sorted text, so that results of two engines compare."""

from __future__ import annotations


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return repr({k: plain(x) for k, x in v.items()})
    return repr(v)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
