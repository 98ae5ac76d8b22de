"""Holds queries against their SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(sql: str, sf_dir: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, [dict(zip(names, r)) for r in cur.fetchall()]


def canonical(names, records) -> list:
    def value(x):
        return round(x, 6) if isinstance(x, float) else x

    return sorted(repr([value(r[n]) for n in sorted(names)]) for r in records)


def check(df, sql: str, sf_dir: str) -> None:
    names, want = rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert canonical(names, [r.asDict() for r in df.collect()]) == canonical(names, want)
