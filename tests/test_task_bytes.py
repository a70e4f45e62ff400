"""Tasks and files whose size is bounded, however large the table is."""

import glob

from pyspark.sql import functions as F

from pharmatext.sources import tables
from registry import preparing
from registry.common import QUERIES


def test_tasks_grow_in_number_with_the_bytes_of_a_table(spark, sf, monkeypatch):
    path = f"{sf}/documents.parquet"
    n_bytes = tables.file_bytes(spark, path)
    monkeypatch.setattr(tables, "TASK_BYTES", n_bytes // 40)
    docs = tables.read_table(spark, path, "doc_id")
    assert 40 <= docs.rdd.getNumPartitions() <= 41
    counts = docs.select(F.col("doc_id").alias("id"), F.explode(F.split("text", " ")).alias("w")).groupBy("id", "w").count()
    assert counts.rdd.getNumPartitions() == docs.rdd.getNumPartitions()  # grouped where the texts were dealt to
    assert docs.count() == spark.read.parquet(path).count()


def test_a_large_csv_is_written_by_several_tasks(spark, sf, monkeypatch):
    written = []
    real = preparing.text_files.write_csv
    monkeypatch.setattr(preparing.text_files, "write_csv", lambda df, path: written.append(path) or real(df, path))
    whole = sorted(map(tuple, QUERIES["csv_scan_split"](spark, sf).collect()), key=str)
    monkeypatch.setattr(preparing, "CSV_FILE_BYTES", tables.file_bytes(spark, f"{sf}/documents.parquet") // 3)
    split = sorted(map(tuple, QUERIES["csv_scan_split"](spark, sf).collect()), key=str)
    files = [len(glob.glob(f"{p.removeprefix('file:')}/*.csv")) for p in written]
    assert files[0] == 1 and files[1] in (3, 4)
    assert split == whole
