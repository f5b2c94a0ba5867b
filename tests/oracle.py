"""Compares a registered query with its DuckDB SQL on the same tables."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "INTEGER": "int", "VARCHAR[]": "array<string>"}


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def assert_equal(df, con, sql: str) -> None:
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    assert {c: TYPES[str(t)] for c, t in zip(rel.columns, rel.types)} == dict(df.dtypes)
    want = sorted(repr([plain(r[rel.columns.index(c)]) for c in names]) for r in rel.fetchall())
    assert sorted(repr([plain(r[c]) for c in names]) for r in df.collect()) == want
