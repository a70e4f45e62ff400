"""Collecting and scoring as streams; the stream's checkpoint holds what is done.

Pages of a batch are dealt out over the cores before they are read, so a batch of few files is no work for few
tasks. Collecting writes through the file sink, whose commits are exactly-once. Scoring writes with
``foreachBatch``: a batch that is run again after a failure overwrites its own output folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pharmatext.operators.clean import text_key
from pharmatext.operators.collect import extract_reviews
from pharmatext.plans.classifier import TrainedModel
from pharmatext.sources.tables import spread_stream

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _reviews(pages: DataFrame, **columns: bool) -> DataFrame:
    return extract_reviews(spread_stream(pages, "page_id"), **columns)


def collect_stream(pages: DataFrame, output: str, checkpoint: str, **columns: bool) -> StreamingQuery:
    """Reviews of arriving pages to parquet below ``output``: exactly the rows of the batch form.

    Stateless, so no watermark and no state store: one file sink with exactly-once commits.
    """
    return (
        _reviews(pages, **columns).writeStream.format("parquet")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def collect_distinct_stream(
    pages: DataFrame, output: str, checkpoint: str, **columns: bool
) -> StreamingQuery:
    """As ``collect_stream``, with each comment stored once (one of its copies), over all batches.

    The digests seen so far are the stream's keyed state, so a batch costs what it brings, not what
    went before. For long streams set the RocksDB state store, which keeps them on disk.
    """
    reviews = _reviews(pages, **columns).withColumn("text_key", text_key(F.col("comment")))
    return (
        reviews.dropDuplicates(["text_key"]).writeStream.format("parquet")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def collect_first_stream(pages: DataFrame, output: str, checkpoint: str, **columns: bool) -> StreamingQuery:
    """As ``collect_stream``, with the first review (by page and place) of each comment over all batches: what
    ``dedup_text`` keeps, however the pages are split into batches. ``first_reviews`` reads the result.

    The keyed state holds the least place of each comment's digest, and its review, in RocksDB on disk. When an
    earlier place arrives later, the corrected review is written too; a batch that runs again replaces
    its own rows. Tasks combine their own copies of a comment before the shuffle.
    """
    spark = pages.sparkSession
    reviews = _reviews(pages, **columns)
    first = F.min_by(F.struct(*reviews.columns), F.struct("page_id", "pos")).alias("review")
    state = reviews.groupBy(text_key(F.col("comment")).alias("text_key")).agg(first)

    def store(batch: DataFrame, number: int) -> None:
        batch.select("text_key", "review.*").write.mode("overwrite").parquet(f"{output}/batch={number}")

    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # a query keeps the settings that it starts with
    try:
        return (
            state.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def first_reviews(spark: SparkSession, output: str) -> DataFrame:
    """The reviews of ``collect_first_stream``: of each comment the one that stands first of all written."""
    stored = spark.read.parquet(f"{output}/batch=*")
    columns = [c for c in stored.columns if c != "text_key"]
    first = F.min_by(F.struct(*columns), F.struct("page_id", "pos")).alias("review")
    return stored.groupBy("text_key").agg(first).select("review.*")


def classify_stream(
    texts: DataFrame, model: TrainedModel, output: str, checkpoint: str,
    text: str = "text", id_col: str = "id", keep: list[str] | None = None,
) -> StreamingQuery:
    """Predicted class of every arriving text, to parquet below ``output``."""

    def store(batch: DataFrame, number: int) -> None:
        scored = model.predict(batch, text, id_col, keep)
        scored.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        texts.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
