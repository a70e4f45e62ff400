"""Ranks, folds and joins under skew, against plain single-window forms."""

import pytest
from pyspark.sql import Window, functions as F

from conftest import rows
from pharmatext.operators.folds import stratified_folds
from pharmatext.plans.joins import join_measured, join_table, table_size
from pharmatext.plans.ranking import with_global_rank, with_rank
from pharmatext.plans.storage import materialize, shared_dir


def skewed(spark, n=2000):
    """Nearly all rows in one class, ids with large gaps and in no order."""
    ids = [(i * 7919) % 10007 for i in range(n)]
    return spark.createDataFrame([(i if i % 3 else i * 1000, float(i % 50 == 0)) for i in ids], "id bigint, label double") \
        .dropDuplicates(["id"])


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_rank_within_a_hot_group(spark, slices):
    df = skewed(spark)
    plain = df.withColumn("rank", (F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).cast("bigint"))
    assert rows(with_rank(df, "id", ["label"], slices=slices)) == rows(plain)


@pytest.mark.parametrize("slices", [1, 5])
def test_global_rank_and_text_order(spark, slices):
    words = ["a", "b", "ab", "é", "z", "zz", "ñ", "0", "$", "日本", "日", "aaaaaaaab", "aaaaaaaaa"]
    df = spark.createDataFrame([(w, len(w) % 3) for w in words], "term string, n int")
    order = Window.orderBy(F.col("n").desc(), "term")
    plain = df.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))
    assert rows(with_global_rank(df, "n", "term", descending=True, slices=slices)) == rows(plain)
    flat = df.withColumn("rank", (F.row_number().over(Window.orderBy("term")) - 1).cast("bigint"))
    assert rows(with_rank(df, "term", slices=slices)) == rows(flat)


def test_rank_without_broadcast(spark):
    df = skewed(spark)
    assert rows(with_rank(df, "id", ["label"], slices=4, limit=0)) == rows(with_rank(df, "id", ["label"], slices=4))


def test_a_hot_group_is_spread_and_no_window_runs_over_rows(spark):
    ranked = with_rank(skewed(spark), "id", ["label"], slices=8)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan
    assert len(ranked.inputFiles()) >= 8


def test_text_order_with_one_long_common_prefix(spark):
    df = spark.range(3000).select(F.concat(F.lit("0" * 40), F.format_string("%05d", (F.col("id") * 7) % 3000)).alias("term"))
    got = with_rank(df, "term", slices=6)
    assert got.filter(F.substring("term", 41, 5).cast("bigint") != F.col("rank")).count() == 0
    assert len(got.inputFiles()) >= 6


@pytest.mark.parametrize("k", [2, 3, 10])
def test_folds_equal_ntile(spark, k):
    df = skewed(spark, 500).unionByName(spark.createDataFrame([(-1, 7.0), (-2, 7.0)], "id bigint, label double"))
    block = F.ntile(k).over(Window.partitionBy("label").orderBy("id")) - 1
    assert rows(stratified_folds(df, k, slices=5)) == rows(df.withColumn("fold", block.cast("int")))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_shuffle_join_equals_broadcast(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"w{i % 11}" if i % 5 else None) for i in range(300)], "id int, term string")
    right = spark.createDataFrame([("hot", 1), ("w1", 2), ("w2", 3), ("unused", 4)], "term string, v int")
    plain = join_table(left, right, "term", 1, how, limit=0)
    assert rows(plain, *left.columns) == rows(left.join(right, "term", how), *left.columns)
    assert rows(join_measured(left, right, "term", how)) == rows(left.join(right, "term", how))


def test_the_hot_key_of_a_shuffle_join_is_split(spark):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        left = spark.range(0, 200_000, 1, 16).select("id", F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("term"))
        right = spark.range(2000).select(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string")).alias("term"), F.lit(1).alias("v"))
        joined = join_table(left, right, "term", 1 << 40).withColumn("p", F.spark_partition_id())
        assert joined.filter("term = 'hot'").select("p").distinct().count() > 1
        assert joined.count() == 200_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_table_size_counts_key_bytes(spark):
    table = spark.createDataFrame([("aé",), ("b" * 100,)], "term string")
    assert table_size(table, "term", row_bytes=10) == (2, 3 + 100 + 20)


def test_shared_storage_is_the_configured_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and shared_dir(spark) in df.inputFiles()[0]
