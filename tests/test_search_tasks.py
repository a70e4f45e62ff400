"""Search result pages are read by many tasks, though the table they come from is one small file."""

from registry.collecting import search_pages


def test_search_pages_are_spread(spark, sf):
    assert spark.read.parquet(f"{sf}/part.parquet").rdd.getNumPartitions() < 2 * spark.sparkContext.defaultParallelism
    assert search_pages(spark, sf).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
