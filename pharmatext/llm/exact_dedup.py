"""Exact deduplication as a stateful stream with full-byte checks.

The stream reads the table's files. Its keyed state (RocksDB, on disk, never expired) holds for each
digest of a normalised text the stable identifier of the row that stays, the content locator (the
id's row in the stored table) and the number of rows. It is a streaming aggregate, so each task first
combines its own rows of a digest: a text that makes up a third of all rows costs one row per task.
Every change of state is appended to a table in the shared folder, and the last one per digest counts.

A digest that was hit is only a claim. Each row of such a group is compared, byte by byte, with the
text that its locator leads to; rows that differ are grouped by their whole text instead.

Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest
id stays; a null id is below all others. Of repeated rows (same id) each gets the same answer, and
all of them are "kept" if theirs is the id that stays. Further columns of any name are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pharmatext.llm.storage import fresh, scratch, shared_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """UTF-8 bytes of the text with A-Z lower-cased; of null, no bytes."""
    return F.encode(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "UTF-8")


def state_of(source_path: str, spark, schema, id_col: str, text_col: str, digest_bytes: int = 32) -> DataFrame:
    """(digest, keep_id, n) from a stream over the parquet files of ``source_path``."""
    setting = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        # a task closes its part of the state when it is done: each open part holds some MB of disk and memory
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    }
    before = {k: spark.conf.get(k, None) for k in setting}
    log, checkpoint = shared_path(spark, "dedup-log"), shared_path(spark, "dedup-state")
    digest = F.substring(F.unhex(F.sha2(normalised(F.col(text_col)), 256)), 1, digest_bytes)
    # written as a pattern, since a stream takes a single file only so
    pattern = f"{source_path[:-1]}[{source_path[-1]}]"
    stream = spark.readStream.schema(schema).parquet(pattern)
    state = stream.select(digest.alias("digest"), F.col(id_col).cast("long").alias("id")).groupBy("digest").agg(
        F.max("id").alias("keep_id"), F.count("*").alias("n"))
    log_schema = "digest binary, keep_id long, n long, batch long"

    def append(changed: DataFrame, batch: int) -> None:
        # a batch that is run again overwrites its own folder, so nothing counts twice
        changed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{log}/batch={batch}")

    try:
        for k, v in setting.items():
            spark.conf.set(k, v)
        (stream_query := state.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()).awaitTermination()
        ran = stream_query.lastProgress is not None
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not ran:
        return spark.createDataFrame([], "digest binary, keep_id long, n long")
    changes = spark.read.schema(log_schema).parquet(f"{log}/batch=*")
    last = changes.groupBy("digest").agg(F.max(F.struct("batch", "keep_id", "n")).alias("s"))
    return last.select("digest", "s.keep_id", "s.n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_path: str | None = None, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    ``source_path`` is the folder of parquet files behind ``docs``, if there is one; else the two
    columns are written first. ``digest_bytes`` shortens the digest (tests make digests collide).
    """
    spark = docs.sparkSession
    if source_path is None:
        source_path = shared_path(spark, "dedup-input")
        docs.select(id_col, text_col).write.parquet(source_path)
    rows = spark.read.schema(docs.select(id_col, text_col).schema).parquet(source_path)
    state = state_of(source_path, spark, rows.schema, id_col, text_col, digest_bytes)
    whole = F.sha2(normalised(F.col(text_col)), 256)
    keyed = rows.select(F.col(id_col).cast("long").alias("doc_id"), whole.alias("text_sha256"))
    keyed = keyed.withColumn("digest", F.substring(F.unhex("text_sha256"), 1, digest_bytes))
    grouped = written(keyed.join(state, "digest").select("doc_id", "text_sha256", "keep_id", "n"), "dedup-groups")
    differing = _differing(rows, grouped, id_col, text_col)
    if differing.isEmpty():
        out = grouped.select("doc_id", "keep_id", F.col("n").alias("group_size"), "text_sha256")
    else:
        out = _regrouped(rows, state, id_col, text_col, digest_bytes)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _differing(rows: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids of rows of shared digests whose bytes are not those that their group's locator leads to."""
    hits = grouped.filter("n > 1").select("doc_id", "keep_id").distinct()
    texts = rows.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("bytes"))
    involved = hits.select(F.explode(F.array("doc_id", "keep_id")).alias("h")).distinct()
    # only texts of shared digests go on; null ids can't be located and count as differing
    held = written(texts.join(involved, F.col("id").eqNullSafe(F.col("h")), "left_semi"), "dedup-hits")
    own, kept = held.select(F.col("id").alias("doc_id"), "bytes"), held.select(F.col("id").alias("keep_id"), F.col("bytes").alias("kept_bytes"))
    met = hits.join(own, hits["doc_id"].eqNullSafe(own["doc_id"])).select(hits["doc_id"], hits["keep_id"], "bytes")
    met = met.join(kept, met["keep_id"].eqNullSafe(kept["keep_id"]))
    return met.filter("bytes != kept_bytes OR doc_id IS NULL").select("doc_id")


def _regrouped(rows: DataFrame, state: DataFrame, id_col: str, text_col: str, digest_bytes: int) -> DataFrame:
    """Groups by whole text: the way out when digests collide."""
    full = rows.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("bytes"))
    groups = full.groupBy("bytes").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return full.join(groups, "bytes").select("doc_id", "keep_id", "group_size", F.sha2("bytes", 256).alias("text_sha256"))


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with the same id and text, one."""
    own, key, digest, n = (fresh(docs, name) for name in ("_own", "_id", "_digest", "_n"))
    with scratch(docs.sparkSession):
        winners = exact_groups(docs, id_col, text_col).filter("kept")
        winners = winners.groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest)).agg(F.count("*").alias(n))
        winners = written(winners, "dedup-kept", lasting=True)
    hashed = docs.withColumn(own, F.sha2(normalised(F.col(text_col)), 256))
    met = hashed.join(winners, F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (F.col(own) == F.col(digest)), "left_semi")
    # only repeated rows make winners repeat; without any there is nothing to drop
    once = met if winners.filter(F.col(n) > 1).isEmpty() else met.dropDuplicates([id_col, own])
    return once.drop(own)
