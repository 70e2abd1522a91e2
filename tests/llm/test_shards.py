"""Jump consistent hashing against its scalar definition; slots; what moves when a shard is added."""

import pytest

import zlib

import numpy as np

from furrow.llm.shards import jump_hash, shard_documents, write_shards


def scalar(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & 0xFFFFFFFFFFFFFFFF
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_same_as_scalar():
    keys = np.concatenate([np.arange(50, dtype=np.uint64), np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)])
    for shards in (1, 2, 16, 17, 1000):
        assert jump_hash(keys, shards).tolist() == [scalar(int(k), shards) for k in keys]


def test_only_the_needed_share_moves():
    keys = np.random.default_rng(2).integers(0, 2**64, 100_000, dtype=np.uint64)
    for shards in (1, 7, 16):
        a, b = jump_hash(keys, shards), jump_hash(keys, shards + 1)
        moved = a != b
        assert (b[moved] == shards).all() and abs(moved.mean() - 1 / (shards + 1)) < 0.01
        assert np.bincount(a, minlength=shards).min() > 0.9 * len(keys) / shards


def check(rows, got):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert set(by) <= set(range(16))
    of = {}
    assert all(of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) for r in got)


def test_nulls_and_a_hot_key(spark, tmp_path):
    rows = [(i, f"é{i}") for i in range(300)] + [(5, "again")] * 200 + [(None, None)] * 30 + [(7, "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, shard int, slot int").repartition(7)
    got = shard_documents(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)
    write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(r.doc_id, r.shard) for r in got}
    assert shard_documents(docs.limit(0)).collect() == []


def test_registered_query(spark, sf_dir):
    from furrow.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op4_sharding"](spark, sf_dir).collect()
    assert len(got) == len(rows)
    check(rows, got)


def test_own_shard_column_is_an_error(spark, tmp_path):
    from furrow.llm.shards import write_shards
    with pytest.raises(ValueError):
        write_shards(spark.createDataFrame([(1, 2)], "doc_id long, Shard int"), str(tmp_path / "out"))
