"""Compare a Spark result with DuckDB SQL over the same Parquet files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if hasattr(v, "isoformat") else v


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    return [d[0] for d in rel.description], rel.fetchall()


def same(df, sql, sf_dir):
    names, want = oracle_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    got = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)
