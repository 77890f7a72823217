"""Exact deduplication with an extendible-hash index on shared files.

The key of a row is a 64-bit hash of its text. Keys alone are counted first, and the
texts of keys that occur once are not moved. A directory maps the leading
bits of the other keys to a bucket: an overfull bucket is split by one more bit, and the
directory doubles when that bucket used all of its bits; what is stored of it are its
buckets, so that it stays as small as their number. The buckets are
written to the folder that all executors share, a range of keys to a file;
owner tasks then process a range each. Rows of equal key form a chain in which
texts are compared byte by byte, so a collision of hashes never makes a copy. Copies
that lie in one block of rows are brought together before anything is moved, so
that a text of very many copies reaches its owner a few times only.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .shared import cut, free, sent_if_small, shared_table

#: Bytes in a bucket and in an owner's range, about; a larger index has so many buckets and owners, which are larger then.
BUCKET_BYTES, OWNER_BYTES, MOST_BUCKETS, MOST_OWNERS = 4 << 20, 24 << 20, 1 << 17, 1 << 14
#: An entry counts as its text and so many bytes, and so many for each row; rows in a block.
ENTRY_BYTES, ID_BYTES, BLOCK_ROWS = 64, 8, 100_000
#: Bits that a bucket may have beyond those of an even directory. What is overfull then holds many entries of few keys.
SPARE_BITS = 6


@dataclass
class Directory:
    """The buckets as (prefix, bits, bytes) in the order of keys, and the owner of each; a bucket of fewer than ``depth`` bits stands at several entries."""

    depth: int
    owner: list[int]
    buckets: list[tuple[int, int, int]]

    def ranges(self) -> list[tuple[int, int, int]]:
        """(first prefix of ``depth`` bits, the one behind the last, owner)."""
        out: list[list[int]] = []
        for (p, bits, _), o in zip(self.buckets, self.owner):
            lo, hi = p << (self.depth - bits), (p + 1) << (self.depth - bits)
            if out and out[-1][2] == o:
                out[-1][1] = hi
            else:
                out.append([lo, hi, o])
        return [tuple(r) for r in out]


def build_directory(sizes: Callable[[int, list[int], int], dict[int, int]], bits: int, bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES) -> Directory:
    """Split buckets until none is overfull, or until it has used up its bits.

    ``sizes(depth, within, at)`` gives the bytes by prefix of ``depth`` bits inside
    the prefixes ``within`` of ``at`` bits. It is asked for the whole, for the even directory, and for
    what that leaves overfull.
    """
    total = sizes(0, [0], 0).get(0, 0)
    bucket_bytes, owner_bytes = max(bucket_bytes, total // MOST_BUCKETS), max(owner_bytes, total // MOST_OWNERS)
    even = min(bits, math.ceil(math.log2(max(1, total / bucket_bytes))) + (total > bucket_bytes))
    most = min(bits, even + SPARE_BITS)
    done: list[tuple[int, int, int]] = []
    open_, depth = [0], 0
    for step in (even, most - even):
        levels: list[dict[int, int]] = [{} for _ in range(step + 1)]
        levels[step] = sizes(depth + step, open_, depth)
        for d in range(step, 0, -1):
            for p, n in levels[d].items():
                levels[d - 1][p >> 1] = levels[d - 1].get(p >> 1, 0) + n
        waiting, open_ = [(p, 0) for p in open_], []
        while waiting:
            p, d = waiting.pop()
            n = levels[d].get(p, 0)
            if n <= bucket_bytes or depth + d >= most:
                done.append((p, depth + d, n))
            elif d == step:
                open_.append(p)
            else:
                waiting += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        depth += step
        if not open_:
            break
    top = max(d for _, d, _ in done)
    done.sort(key=lambda b: b[0] << (top - b[1]))
    owners, owner, held = [], 0, 0
    for _, _, n in done:
        if held and held + n > owner_bytes:
            owner, held = owner + 1, 0
        held += n
        owners.append(owner)
    return Directory(top, owners, done)


@dataclass
class Index:
    """The bucket files of each owner; the helper columns in them."""

    files: dict[int, list[str]]
    key: str
    owner: str


def _key_of(key: Callable[[Column], Column]) -> Column:
    return F.when(F.col("text").isNotNull(), key(F.col("text")))


def write_index(
    docs: DataFrame, held: Callable[[DataFrame], list[Column]], least: str, key: Callable[[Column], Column] = F.xxhash64, bits: int = 64,
    bucket_bytes: int = BUCKET_BYTES, owner_bytes: int = OWNER_BYTES, block_rows: int = BLOCK_ROWS,
) -> tuple[Index, DataFrame]:
    """Write an entry for each text of a repeated key and each block of rows, in the order of key and ``least``; the repeated keys ``(k)``.

    ``held`` are the aggregates that an entry holds besides its text; the column ``least`` among them sorts it, nulls last.
    ``key`` makes a long of the text, of which the low ``bits`` bits count. Null texts are not indexed.
    """
    spark = docs.sparkSession
    k, o, p, block = free(docs, "key", "owner", "prefix", "block")
    numbered = F.floor(F.monotonically_increasing_id() / F.lit(block_rows))
    light = cut(docs.select(_key_of(key).alias("k"), F.octet_length("text").cast("long").alias("n"), numbered.alias("block")).filter("k is not null"))
    repeated = cut(light.groupBy("k").agg(F.count("*").alias("times")).filter("times > 1").select("k"))
    repeated = sent_if_small(repeated)
    sized = light.join(repeated, "k").groupBy("k", "block").agg((F.max("n") + F.lit(ENTRY_BYTES) + F.count("*") * ID_BYTES).alias("n"))

    def prefix(of: str, depth: int) -> Column:
        return F.shiftrightunsigned(of, bits - depth) if depth else F.lit(0).cast("long")

    def sizes(depth: int, within: list[int], at: int) -> dict[int, int]:
        rows = sized.filter(prefix("k", at).isin(within)) if at else sized
        return {r.p: r.n for r in rows.groupBy(prefix("k", depth).alias("p")).agg(F.sum("n").alias("n")).collect()}

    directory = build_directory(sizes, bits, bucket_bytes, owner_bytes)
    # The owners' ranges, found by the leading bits of a prefix: at most two rows for each owner and one for each head.
    heads = min(directory.depth, 14)
    rows = [(h, lo, hi, own) for lo, hi, own in directory.ranges() for h in range(lo >> (directory.depth - heads), ((hi - 1) >> (directory.depth - heads)) + 1)]
    h, lo, hi = free(docs, "head", "lo", "hi")
    table = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64() if n != o else pa.int32()) for n, c in zip((h, lo, hi, o), zip(*rows))}))
    indexed = docs.withColumn(k, _key_of(key)).join(repeated.withColumnRenamed("k", p), F.col(k) == F.col(p), "left_semi").withColumn(block, numbered)
    entries = indexed.groupBy(k, block, "text").agg(*held(indexed)).withColumn(p, prefix(k, directory.depth))
    path = shared_table(spark, "index")
    (
        entries.join(F.broadcast(table), (F.shiftright(p, directory.depth - heads) == F.col(h)) & (F.col(p) >= F.col(lo)) & (F.col(p) < F.col(hi)))
        .drop(block, p, h, lo, hi)
        .repartitionById(directory.owner[-1] + 1, F.col(o)).sortWithinPartitions(k, F.col(least).asc_nulls_last())
        .write.option("compression", "zstd").parquet(path)
    )
    files: dict[int, list[str]] = {}
    for f in sorted(spark.read.schema("text string").parquet(path).inputFiles()):
        files.setdefault(int(re.match(r"part-(\d+)", os.path.basename(f))[1]), []).append(f)
    return Index(files, k, o), repeated


def walk(uris: list[str], owner: int, index: Index, least: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[bool, int | None]]]]:
    """An owner's entries by batch: whether each is the first of its text, and the least id of that text."""
    last, chain = None, []
    for uri in uris:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as handle:
            for b in pq.ParquetFile(handle).iter_batches(batch_size=1024):
                if not b.num_rows:
                    continue
                assert set(b.column(index.owner).unique().to_pylist()) == {owner}, "a bucket file holds rows of another owner"
                found = []
                for key, text, own in zip(b.column(index.key).to_pylist(), b.column("text"), b.column(least).to_pylist()):
                    if key != last:
                        last, chain = key, []
                    raw = text.as_buffer().to_pybytes()
                    for other, kept in chain:
                        if raw == other:
                            found.append((False, kept))
                            break
                    else:
                        chain.append((raw, own))
                        found.append((True, own))
                yield b, found


def _owners(docs: DataFrame, index: Index) -> DataFrame:
    rows = sorted(index.files.items())
    spark = docs.sparkSession
    return spark.createDataFrame([(i, n, f) for i, (n, f) in enumerate(rows)], "place int, owner int, files array<string>").repartitionById(max(1, len(rows)), F.col("place"))


def copies(docs: DataFrame, **index_options) -> DataFrame:
    """``(doc_id, keep_id)`` for each row that repeats the text of another.

    ``keep_id`` is the least ``doc_id`` of that text (null orders last). Of a row
    repeated whole, one stays and the others are copies of their own id. Null
    texts are never copies; empty texts are copies of each other. A table
    without copies, or without rows, gives no row.
    """
    ids, least = free(docs, "ids", "least")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"))
    held = lambda _: [F.transform(F.sort_array(F.collect_list(place)), lambda x: x["id"]).alias(ids), F.min(place)["id"].alias(least)]
    index, _ = write_index(docs.select("doc_id", "text"), held, least, **index_options)
    schema = StructType([StructField("doc_id", LongType()), StructField("keep_id", LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for row in own.to_pylist():
                for b, found in walk(row["files"], row["owner"], index, least):
                    copy, keep = [], []
                    for of, (first, kept) in zip(b.column(ids).to_pylist(), found):
                        copy += of[first:]
                        keep += [kept] * (len(of) - first)
                    yield pa.RecordBatch.from_arrays([pa.array(copy, pa.int64()), pa.array(keep, pa.int64())], schema=arrow)

    return _owners(docs, index).mapInArrow(run, schema)


def drop_copies(docs: DataFrame, **index_options) -> DataFrame:
    """The rows of ``docs``, whole, without those that ``copies`` would name.

    Of each text the row of least ``doc_id`` stays (null orders last; of rows of one id and text the one of least hash).
    Null texts all stay; an empty table stays empty; other columns may have any names and types.
    """
    row, least = free(docs, "row", "least")
    others = [c for c in docs.columns if c.lower() != "text"]
    plain = [n for n, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(*plain).alias("h"))
    held = lambda _: [F.min_by(F.struct(*others), order).alias(row), F.min(order)["id"].cast("long").alias(least)]
    index, repeated = write_index(docs, held, least, **index_options)
    text = next(c for c in docs.columns if c.lower() == "text")
    arrow = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for r in own.to_pylist():
                for b, found in walk(r["files"], r["owner"], index, least):
                    kept = b.filter(pa.array([first for first, _ in found]))
                    fields = dict(zip(others, kept.column(row).flatten())) | {text: kept.column("text")}
                    yield pa.RecordBatch.from_arrays([fields[f.name].cast(f.type) for f in arrow], schema=arrow)

    (k,) = free(docs, "k")
    key = index_options.get("key", F.xxhash64)
    once = docs.join(repeated.withColumnRenamed("k", k), _key_of(key) == F.col(k), "left_anti")
    return once.unionByName(_owners(docs, index).mapInArrow(run, docs.schema))
