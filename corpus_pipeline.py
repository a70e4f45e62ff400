"""Documents through the stages of a training-text pipeline.

Each stage works on all rows that the one before kept, and its decisions take effect; the rows between
stages are Parquet. All but the last stage return the columns of ``documents``:

1. quality classifier: rows that the importance resampling leaves out go (labels: ``labels.quality``);
2. exact dedup: of rows with the same text, lower-casing A-Z, the one with the largest id stays;
3. MinHash near-dedup: of each class of near copies the row with the least id stays;
4. mixing: rows as often as the mix of sources to target weights takes them;
5. SentencePiece: the piece ids of every row, with the text that they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pharmatext.llm import exact_dedup, mixing, near_dedup, pieces, quality
from pharmatext.llm.queries import tokenizer_file
from pharmatext.llm.storage import written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept_rows(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("exact dedup", dedup),
    ("near dedup", near),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL can't express the learned, sampled and hashed stages; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
