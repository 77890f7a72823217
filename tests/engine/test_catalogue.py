import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

from fathomlake import catalogue, catalogue_tables  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, (Decimal, float)):
            return None if math.isnan(x) else float(x) + 0.0
        if isinstance(x, datetime.datetime):
            return x.replace(tzinfo=None)
        return x

    return sorted((tuple(map(one, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = plain(df.collect())
    assert got
    if name in catalogue.ORACLE_SQL and catalogue.ORACLE_SQL[name]:
        rel = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(rel.columns) == sorted(df.columns)
        want = plain(duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({catalogue.ORACLE_SQL[name]})").fetchall())
        assert len(got) == len(want)
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        assert not bad, bad[:5]
