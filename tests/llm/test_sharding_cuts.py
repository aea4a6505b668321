"""Cuts by each shard's own rows, leases that are renewed, files that are gone before they are committed."""

import pytest
from pyspark.sql import functions as F

from lacuna.llm import sharding
from lacuna.llm.shared import Scratch


def letters(n, size, start):
    """Rows that hardly compress."""
    return F.concat(*[F.sha2(F.concat_ws("-", F.lit(start + k), F.col("id")), 512) for k in range(max(1, size // 128))])


def test_each_oversized_shard_is_cut_by_its_own_rows(spark):
    store = sharding.ShardStore(spark, Scratch(spark, "cuts").path("store"))
    store.append(spark.range(2).coalesce(1).select("id", letters(2, 120_000, 0).alias("text")))
    store.append(spark.range(800).coalesce(1).select((F.col("id") + 100).alias("id"), letters(800, 640, 10**6).alias("text")))
    before = {r["rows"]: r["bytes"] for r in store.manifest().collect()}
    target = min(before.values()) // 4
    assert len(store.oversized(target).collect()) == 2
    store.compact(target)
    shards = store.manifest().collect()
    assert len(shards) < 40 and sum(r["rows"] for r in shards) == 802
    assert sorted(r["id"] for r in store.read().select("id").collect()) == [0, 1, *range(100, 900)]


def test_lease_is_renewed(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RENEWAL_SECONDS", 0.05)
    store = sharding.ShardStore(spark, Scratch(spark, "lease").path("store"))
    with store._writing() as folder:
        lease = store._path(f"{store.root}/writers/{folder.rsplit('/', 1)[1]}")
        store._fs.setTimes(lease, 1000, -1)
        import time

        time.sleep(0.5)
        assert store._fs.getFileStatus(lease).getModificationTime() > 10**12
    assert not store._fs.exists(lease)


def test_files_gone_before_the_commit(spark):
    store = sharding.ShardStore(spark, Scratch(spark, "gone").path("store"))
    added = spark.createDataFrame([(f"{store.root}/shards/x/part-0.parquet", 1, 1, 0, 0)], sharding.MANIFEST)
    with pytest.raises(sharding.CommitConflict):
        store._change(added, [], spark.range(1).schema)
    assert store.version() == 0


def test_no_python_on_the_executors(spark, monkeypatch):
    from pyspark.core import rdd

    given, wrap = [], rdd._wrap_function
    monkeypatch.setattr(rdd, "_wrap_function", lambda *args, **named: given.append(args[1]) or wrap(*args, **named))
    docs = spark.range(40).select("id", letters(40, 640, 0).alias("text"))
    store = sharding.shard([docs.where(F.col("id") % 5 == k).coalesce(1) for k in range(5)], Scratch(spark, "plain").path("store"))
    assert store.manifest().count() < store.appended()
    assert sorted(r["id"] for r in store.read(described=True).select("id").collect()) == list(range(40))
    empty = sharding.shard([docs.where("false")], Scratch(spark, "none").path("store"))
    assert empty.read(described=True).collect() == []
    assert not given
