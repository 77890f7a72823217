"""Large ids beside nulls in one batch stay as they are, in every operator that gives ids."""

import pytest

from fathomlake.llm import exactdedup, langid, mixing, neardup, packing, quality, secrets, sharding, tokencount

from .conftest import prose, row

LARGE = [2**62 + 1, 2**62 + 2, None]
KEY = "xK9mQ2vL8pR4tW7yB3nD6fH1"


@pytest.fixture(scope="module")
def docs(make):
    return make([row(i, f"{prose(40 + k, 30)} token = {KEY}") for k, i in enumerate(LARGE)]).coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")


def test_each_row_has_its_own_id(docs, labels):
    for got in (langid.identify(docs), tokencount.count_tokens(docs), quality.score(docs, labels), secrets.scan(docs), packing.pack(docs), sharding.shard(docs), mixing.plan(docs, {"s0": 1})):
        assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(LARGE, key=str), got.columns


def test_copies_name_exact_ids(make):
    text = prose(50, 40)
    twice = make([row(i, text) for i in (*LARGE, 2**62 + 3)]).coalesce(1)
    assert {(r.doc_id, r.keep_id) for r in exactdedup.copies(twice).collect()} == {(i, 2**62 + 1) for i in (2**62 + 2, 2**62 + 3, None)}
    assert {(r.doc_id, r.keep_id) for r in neardup.near_copies(twice).collect()} == {(i, 2**62 + 1) for i in (2**62 + 2, 2**62 + 3, None)}
    assert [r.doc_id for r in neardup.drop_near_copies(twice).collect()] == [2**62 + 1]
    assert quality.keep_good(twice, make([]).selectExpr("doc_id", "owner quality")).count() == 4
