import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomlake.llm import exactdedup as ed
from fathomlake.llm import shared

from .conftest import prose, row, rows


def brute(table):
    kept, out = {}, []
    for r in sorted(table, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[1] is None:
            continue
        if r[1] in kept:
            out.append((r[0], kept[r[1]]))
        else:
            kept[r[1]] = r[0]
    return out


def data(n=300):
    rng = np.random.default_rng(4)
    texts = [prose(i, 5 + i % 40) for i in range(n // 3)] + ["", None, "hot"]
    return [row(int(rng.integers(0, n)), texts[int(rng.integers(0, len(texts)))]) for _ in range(n)] + [row(1000 + i, "hot") for i in range(200)]


SMALL = [{}, {"bucket_bytes": 500, "owner_bytes": 3000, "block_rows": 7}, {"bucket_bytes": 1, "owner_bytes": 1, "block_rows": 1}]


@pytest.mark.parametrize("options", SMALL)
def test_copies_equal_brute_force(make, options):
    table = data()
    assert rows(ed.copies(make(table), **options)) == sorted(brute(table))


def test_many_repeated_keys_are_joined_by_shuffle(make, monkeypatch):
    monkeypatch.setattr(shared, "SENT_ROWS", -1)
    table = data()
    assert rows(ed.copies(make(table))) == sorted(brute(table))
    assert ed.drop_copies(make(table)).count() == len(table) - len(brute(table))


def test_collisions_are_told_apart_by_bytes(make):
    table = data()
    weak = lambda t: F.pmod(F.length(t), F.lit(4)).cast("long")
    got = ed.copies(make(table), key=weak, bits=2, bucket_bytes=2000, owner_bytes=4000)
    assert rows(got) == sorted(brute(table))


@pytest.mark.parametrize("options", SMALL)
def test_whole_rows_stay(make, options):
    table = data()
    docs = make(table)
    out = ed.drop_copies(docs, **options)
    assert out.schema == docs.schema
    kept = rows(out.filter("text is not null").select("doc_id", "text"))
    assert len(kept) == sum(r[1] is not None for r in table) - len(brute(table))
    least = {}
    for r in table:
        if r[1] is not None:
            least[r[1]] = min(least.get(r[1], r[0]), r[0])
    assert {t: i for i, t in kept} == least
    assert out.filter("text is null").count() == sum(r[1] is None for r in table)


def test_directory_splits_and_doubles():
    keys = np.random.default_rng(1).integers(0, 1 << 16, 4000)
    keys[:1500] = 7

    def sizes(depth, within, at):
        k = keys[np.isin(keys >> (16 - at), within)]
        p, n = np.unique(k >> (16 - depth), return_counts=True)
        return dict(zip(p.tolist(), n.tolist()))

    d = ed.build_directory(sizes, 16, 100, 500)
    assert len(d.owner) == len(d.buckets) and d.owner == sorted(d.owner)
    assert sum(n for *_, n in d.buckets) == 4000
    assert all(n <= 100 or p == 7 >> (16 - bits) for p, bits, n in d.buckets)
    covered = sum(1 << (d.depth - bits) for _, bits, _ in d.buckets)
    assert covered == 1 << d.depth
    ranges = d.ranges()
    assert ranges[0][0] == 0 and ranges[-1][1] == 1 << d.depth and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_directory_of_a_hot_text_in_a_huge_table_is_small():
    """A petabyte with half of it in one text: as many buckets as at most allowed, not two to the depth."""
    total = 1 << 50

    def sizes(depth, within, at):
        even = total // 2 >> depth
        out = {p: even for q in within for p in range(q << (depth - at), (q + 1) << (depth - at))}
        out[12345 >> (64 - depth) if depth else 0] += total // 2
        return out

    d = ed.build_directory(sizes, 64)
    assert len(d.buckets) <= 3 * ed.MOST_BUCKETS and d.owner[-1] < 2 * ed.MOST_OWNERS


def test_copies_of_a_block_are_one_entry(make):
    docs = make([row(i, "hot") for i in range(500)] + [row(1000 + i, prose(i, 9)) for i in range(50)]).coalesce(1)
    for block_rows, entries in ((100_000, 1), (100, 5)):
        ids = [F.collect_list("doc_id").alias("ids"), F.min("doc_id").alias("least")]
        index, _ = ed.write_index(docs.select("doc_id", "text"), lambda _: ids, "least", block_rows=block_rows)
        files = [f for fs in index.files.values() for f in fs]
        assert sum(ed.pq.read_table(f.removeprefix("file://")).num_rows for f in files) == entries


def test_edge_cases(edge, empty):
    table = [tuple(r) for r in edge.collect()]
    assert rows(ed.copies(edge)) == rows_of(brute(table))
    assert ed.copies(empty).count() == 0 and ed.drop_copies(empty).count() == 0
    assert ed.drop_copies(edge).count() == edge.count() - len(brute(table))


def rows_of(pairs):
    return sorted(pairs, key=lambda t: tuple((x is None, str(type(x)), x) for x in t))
