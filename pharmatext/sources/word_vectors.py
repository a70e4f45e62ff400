"""Word vectors in the word2vec text format: a header line, then ``word v1 v2 ..`` per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pharmatext.sources.text_files import with_line_order


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(term, idx, vec)``; ``idx`` is the word's position in the file, from 0.

    A directory is read in the order of its file names; the header is the first line.
    """
    lines = with_line_order(spark.read.text(path), "line").filter(F.col("line") > 0)
    parts = F.split(F.regexp_replace("value", r" +$", ""), " ")
    return lines.select(
        F.get(parts, 0).alias("term"), (F.col("line") - 1).alias("idx"),
        F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("vec"),
    )


def write_word_vectors(vectors: DataFrame, path: str, n_words: int, dim: int, mode: str = "error") -> None:
    """``(term, idx, vec)`` as word2vec text, sorted by ``idx`` over the files."""
    spark = vectors.sparkSession
    header = spark.range(1).select(F.lit(-1).cast("bigint").alias("idx"), F.lit(f"{n_words} {dim}").alias("value"))
    body = vectors.select(
        F.col("idx").cast("bigint").alias("idx"),
        F.concat_ws(" ", "term", F.array_join(F.col("vec").cast("array<string>"), " ")).alias("value"))
    header.unionByName(body).orderBy("idx").select("value").write.mode(mode).text(path)
