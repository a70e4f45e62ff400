"""CSV and line files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from pharmatext.functions.fixed_values import NA_STRINGS
from pharmatext.functions.sites import strip
from pharmatext.operators.labelling import explode_ratings
from pharmatext.plans.joins import BROADCAST_BYTES, table_size
from pharmatext.plans.storage import materialize

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def with_line_order(df: DataFrame, name: str = "id") -> DataFrame:
    """Add the 0-based position of each row in its files, for a frame just read from files.

    Within one file block the generated ids follow the file, so a row's position is the block's
    offset plus its distance from the block's first id; only the block table is summed up.
    """
    marked = df.select(
        "*", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mono"),
    )
    blocks = marked.groupBy(F.col("_file").alias("_f"), F.col("_start").alias("_s")).agg(
        F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    if table_size(offsets, "_f")[1] <= BROADCAST_BYTES:
        offsets = F.broadcast(offsets)
    joined = marked.join(offsets, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return joined.select(*df.columns, (F.col("_offset") + F.col("_mono") - F.col("_first")).alias(name))


def _clean_na(value: Column) -> Column:
    return F.when(~value.isin(NA_STRINGS), value)


def _inferred(raw: DataFrame) -> StructType:
    """The narrowest type that all values of each text column have, missing ones aside."""
    kinds = {"int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType()}
    checks = []
    for i, name in enumerate(raw.columns):
        value = _clean_na(F.col(f"`{name}`"))
        checks.append(F.count(value).alias(f"n{i}"))
        checks += [F.count(value.try_cast(kind)).alias(f"{kind}{i}") for kind in kinds]
        checks.append(F.count_if(value.rlike("^(?i:true|false)$")).alias(f"truth{i}"))
    seen = raw.agg(*checks).first()

    def kind(i: int):
        if not seen[f"n{i}"]:
            return StringType()
        if seen[f"truth{i}"] == seen[f"n{i}"]:
            return BooleanType()
        return next((kinds[k] for k in ("int", "bigint", "double") if seen[f"{k}{i}"] == seen[f"n{i}"]), StringType())

    return StructType([StructField(name, kind(i)) for i, name in enumerate(raw.columns)])


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None,
    id_col: str | None = None, multi_line: bool = True,
) -> DataFrame:
    """CSV with a header; the usual missing-value strings become null.

    Give a ``schema`` for typed columns: types come from casts after the missing values are gone.
    Without one, types (whole number, number, truth value, else text; never a date) are inferred from
    a pass over the values that are not missing. With ``multi_line`` quoted fields may hold line
    breaks, and one file is one task; without, large files are split. A missing path is an error.
    """
    reader = spark.read.options(**CSV_OPTIONS, multiLine=str(multi_line).lower())
    if schema is None:
        raw = reader.csv(path)
        typed = _inferred(raw)
    else:
        typed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        raw = reader.schema(StructType([StructField(f.name, StringType()) for f in typed])).csv(path)
    numbered = with_line_order(raw, id_col) if id_col else raw
    return numbered.select(*_typed(typed), *([id_col] if id_col else []))


def _typed(schema: StructType) -> list[Column]:
    """Text columns as the schema's types, missing values as null."""
    columns = []
    for field in schema.fields:
        value = _clean_na(F.col(f"`{field.name}`"))
        if not isinstance(field.dataType, StringType):
            value = value.try_cast(field.dataType)
        columns.append(value.alias(field.name))
    return columns


_RECORD = "file string, start long, n long, text string, begins boolean, ends boolean"


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of file blocks to records. A line begins a record if the quotes before it are even; what a
    block begins or ends in the middle of comes out as a part."""
    block, n, odd, begins, lines = None, 0, False, True, []
    out: list[tuple] = []

    def close(ends: bool) -> None:
        nonlocal n, lines
        if lines:
            out.append((*block, n, "\n".join(lines), begins, ends))
            n, lines = n + 1, []

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal out
        if out:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "start", "n", "text", "begins", "ends"])
        out = []

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "start", "inside", "quotes", "value")]
        for file, start, inside, quotes, value in zip(*columns, strict=True):
            if (file, start) != block:
                close(not odd)
                block, n, odd, begins = (file, start), 0, inside, not inside
            elif not odd:
                close(True)
                begins = True
            lines.append(value)
            odd ^= quotes % 2 == 1
        yield from flushed()
    close(not odd)
    yield from flushed()


def csv_records(spark: SparkSession, path: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``(file, start, n, text)``: the records of CSV files, line breaks in quotes and all. One large file
    is read by many tasks, each from its own byte range.

    Whether a range starts inside a field follows from the quotes of all ranges before it: a first pass counts
    them (a doubled quote counts twice, so it changes nothing), and a running sum over one row for each range gives the
    parity. Records that cross ranges come out in parts, at most two of a range, and are joined by the range they begin in.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"), F.monotonically_increasing_id().alias("_mono"))
    blocks = lines.groupBy("file", "start").agg((F.sum("quotes") % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(blocks.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")), "csv_blocks")
    small = table_size(blocks, "file")[1] <= limit
    placed = lines.join(F.broadcast(blocks) if small else blocks, ["file", "start"])
    if not small:  # a shuffle join forgets the order of lines
        placed = placed.repartition("file", "start").sortWithinPartitions("file", "start", "_mono")
    cut = placed.select("file", "start", "inside", "quotes", "value").mapInArrow(_cut_records, _RECORD)
    whole, part = F.col("begins") & F.col("ends"), ~(F.col("begins") & F.col("ends"))
    # parts are few: stored, numbered without their text, and put together
    parts = materialize(cut.filter(part), "csv_parts")
    in_file = Window.partitionBy("file").orderBy("start", "n")
    of = F.last(F.when(F.col("begins"), F.struct("start", "n")), True).over(in_file).alias("of")
    owners = parts.select("file", "start", "n", "begins").select("file", "start", "n", of)
    joined = parts.join(owners, ["file", "start", "n"]).groupBy("file", "of").agg(
        F.array_sort(F.collect_list(F.struct("start", "n", "text"))).alias("p"))
    joined = joined.select("file", "of.start", "of.n", F.array_join("p.text", "\n").alias("text"))
    return cut.filter(whole).select("file", "start", "n", "text").unionByName(joined)


def read_csv_split(spark: SparkSession, path: str, schema: StructType | str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """As ``read_csv`` with a schema and line breaks in quotes, for files too large for one task each."""
    typed = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    texts = StructType([StructField(f.name, StringType()) for f in typed])
    header = (F.col("start") == 0) & (F.col("n") == 0)
    records = csv_records(spark, path, limit).filter(~header).select(F.regexp_replace("text", "\r$", "").alias("text")).filter("text != ''")
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"} | {"multiLine": "true"}
    return records.select(F.from_csv("text", F.lit(", ".join(f"`{f.name}` string" for f in texts)), options).alias("r")).select("r.*").select(*_typed(typed))


def write_csv(df: DataFrame, path: str, star_types: list[str] | None = None, mode: str = "error") -> None:
    """CSV with a header; a rating map is flattened to one column per star type first."""
    flat = explode_ratings(df, star_types)
    flat.write.mode(mode).options(
        header="true", quote='"', escape='"', emptyValue="",
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """``(url)``, one per line; blank lines drop."""
    urls = spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("url"))
    return urls.filter(F.col("url") != "")


def url_list(spark: SparkSession, path: str | None = None, urls: list[str] | None = None,
             start: int = 0) -> DataFrame:
    """Urls from exactly one of a file and a list; ``start`` skips what was done before."""
    if bool(path) == bool(urls):
        raise ValueError("give either a url file or a list of urls")
    if urls:
        return spark.createDataFrame([(u,) for u in urls[start:]], "url string")
    if not start:
        return read_urls(spark, path)
    lines = with_line_order(spark.read.text(path), "line").filter(F.col("line") >= start)
    return lines.select(F.regexp_replace("value", r"\s+$", "").alias("url")).filter(F.col("url") != "")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """``(name)``, one drug name per line, stripped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("name"))


def write_lines(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    """One value per line; nulls drop."""
    df.select(column).filter(F.col(column).isNotNull()).write.mode(mode).text(path)
