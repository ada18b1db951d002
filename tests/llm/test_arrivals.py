"""Arrivals and merges do not depend on the files of the table."""

import pytest
from pyspark.sql import functions as F

from tabula.llm import sharding


def test_a_table_of_one_file_is_compacted(spark, tmp_path):
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("arrival"), F.create_map(F.lit("k"), "id").alias("m"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    root = str(tmp_path / "store")
    out = sharding.shard(spark.read.parquet(str(tmp_path / "in")), root, target_bytes=20_000)
    assert out.columns == ["id", "arrival", "m", "shard", "version"]
    assert sorted((r["id"], r["arrival"], r["m"]["k"]) for r in out.collect()) == sorted((r["id"], r["arrival"], r["m"]["k"]) for r in rows.collect())
    store = sharding.ShardStore(spark, root)
    now = store.manifest()
    assert now.version == 10 and len(now.runs) == 2 and sum(r.rows for r in now.runs) == 4000  # eight appends, two merges
    assert max(r.files for r in now.runs) > 1, now.runs
    assert len({r.rows for r in store.manifest(3).runs}) == 3


def test_vacuum_spares_writers_and_young_versions(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    for n in range(3):
        store.append(spark.range(n * 10, n * 10 + 10))
    waiting = store._new_name()  # a writer that has written and not committed
    spark.range(30, 40).write.parquet(f"{store.root}/data/{waiting}")
    store.append(spark.range(40, 50))
    assert store.compact() == 1 and store.vacuum() == 0
    assert [store.read(v).count() for v in store.versions()] == [10, 20, 30, 40, 40]
    assert store.vacuum(retention=0) == 4 and store.versions() == [5]
    store._commit_runs([waiting], spark.range(1).schema.json(), ())
    assert {r["id"] for r in store.read().collect()} == set(range(50))
    assert store.vacuum(retention=0) == 0 and store.read(5).count() == 40


def test_a_merge_that_lost_its_runs_is_refused(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    for _ in range(4):
        store.append(spark.range(5))
    chosen = store.manifest().runs
    assert store.compact() == 1
    late = store._merged(chosen, store.manifest().schema, 1 << 20)
    with pytest.raises(sharding.CommitConflict):
        store._commit_runs([late], store.manifest().schema, chosen)
    assert store.read().count() == 20


def test_partition_columns_and_null_rows_stay(spark, tmp_path):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, None, None), (None, None, None), (2, "", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.partitionBy("source").parquet(str(tmp_path / "in"))
    out = sharding.shard(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "store"))
    assert sorted(map(repr, map(tuple, out.select("doc_id", "text", "source").collect()))) == sorted(map(repr, rows))
