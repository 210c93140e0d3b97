"""Run queries beside their SQL and report differences."""

from __future__ import annotations

import math

import duckdb


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        if isinstance(v, bool) or v is None:
            return v
        return round(float(v), 5) if type(v).__name__ == "Decimal" else v

    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


def difference(spark, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    import os

    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    theirs = rows_of(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(wrong)} rows differ, such as {wrong[0]}" if wrong else None
