"""What the session helpers promise: broadcasts by measured size, no machine-local checkpoints on clusters."""

import pytest
from pyspark.sql import functions as F

from tarrafa.session import checkpoint_path, measured_bytes, written


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_aggregate_of_a_large_table_is_broadcast(spark):
    large = spark.range(5_000_000).withColumn("g", F.col("id") % 14)
    few = large.groupBy("g").agg(F.count("*").alias("n"))
    assert "BroadcastHashJoin" in _joins(large.join(written(few), "g"))
    assert "BroadcastHashJoin" not in _joins(large.join(written(few, limit=10), "g"))


def test_measured_sizes_follow_the_rows(spark):
    df = spark.createDataFrame([(1, "a" * 1000, [1, 2]), (2, None, None)], "i long, s string, a array<int>")
    assert 1000 < measured_bytes(df) < 1500
    assert measured_bytes(df.limit(0)) == 0 and measured_bytes(df.select("i")) == 48


def test_checkpoint_folders():
    assert checkpoint_path("hdfs://x/y", "yarn") == "hdfs://x/y"
    assert checkpoint_path(None, "local[4]")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            checkpoint_path(None, master)


def test_files_on_any_file_system(spark, tmp_path):
    from tarrafa.operators.upsert import read_snapshot, write_snapshot
    from tarrafa.session import exists, names, read_text, write_text

    root = f"file://{tmp_path}/none"
    assert read_snapshot(spark, root) is None and not exists(spark, root) and names(spark, root) == []
    for i in range(3):
        write_snapshot(spark.range(i + 1), root)
        assert read_snapshot(spark, root).count() == i + 1
    write_text(spark, f"{root}/x", "olá")
    assert read_text(spark, f"{root}/x") == "olá" and [n for n in names(spark, root) if "part" in n] == []
    with pytest.raises(FileExistsError):
        write_text(spark, f"{root}/x", "y")
    assert read_text(spark, f"{root}/x") == "olá"
