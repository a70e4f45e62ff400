"""Fetched web pages: a table ``(page_id, url, html)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pharmatext.sources.tables import spread

PAGE_SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a stored crawl; a small one is spread over the cores."""
    return spread(spark.read.schema(PAGE_SCHEMA).parquet(path), "page_id")


def stream_pages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Pages as a stream: files that land in ``path`` later are picked up."""
    reader = spark.readStream.schema(PAGE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
