"""Every query with SQL gives the SQL's rows, at the scale and with the digits that the query gives, and some rows at least."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(found, names):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9) + 0.0
        return round(float(v), 9) + 0.0 if type(v).__name__ == "Decimal" else v

    return sorted((tuple(map(plain, r)) for r in found), key=repr)


def compare(spark, name, sql, sf_dir):
    df = entry.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    con.execute("set timezone = 'UTC'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = rows([[r[names.index(c)] for c in order] for r in cursor.fetchall()], order)
    got = rows([[r[c] for c in order] for r in df.collect()], order)
    assert got == want
    return len(got)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert compare(spark, name, ORACLE[name], os.environ.get("TIDEMARK_SF", SF)) > 0


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
