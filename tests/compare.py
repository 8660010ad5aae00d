"""Runs a registered query and its oracle and compares their rows without regard to order."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.sql("set threads = 4")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


def differences(spark, query, sql: str, sf_dir: str) -> list[str]:
    df = query(spark, sf_dir)
    names, rows = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return [f"columns {df.columns} and {names}"]
    order = sorted(names)
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    got = sorted((tuple(_plain(r[n]) for n in order) for r in df.collect()), key=key)
    want = sorted((tuple(_plain(r[names.index(n)]) for n in order) for r in rows), key=key)
    if len(got) != len(want):
        return [f"{len(got)} rows and {len(want)}; {got[:3]} {want[:3]}"]
    return [f"{a} and {b}" for a, b in zip(got, want, strict=True) if a != b][:5]
