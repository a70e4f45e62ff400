"""Document fingerprints: one-permutation MinHash of word shingles, densified and packed.

Each shingle is hashed once: high bits choose one of ``bins`` bins, the rest is its value, and each
bin keeps its least value. An empty bin takes over a filled bin picked by a fixed random walk that
depends on the bin alone (optimal densification). Only the low ``bits`` bits of each bin are stored,
as hexadecimal text; ``likeness`` corrects for bins that agree by chance.

A null or empty text, or one without words, has the fingerprint ``""``: like another such (1.0),
unlike everything else (0.0). Equal texts have equal fingerprints; texts of one to four words are one
shingle. Very long texts only take longer: state per text is one value for each bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pharmatext.llm.storage import small_batches, tasks
from pharmatext.llm.words import mix, text_shingles

BINS, BITS = 256, 8
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def donors(bins: int, probes: int = 64) -> np.ndarray:
    """For each bin the bins it asks in turn while it is empty: the same for every document."""
    asks = np.arange(bins * probes, dtype=np.uint64) + np.uint64(1)
    return (mix(asks) % np.uint64(bins)).astype(np.int64).reshape(bins, probes)


def sketch(hashes: np.ndarray, bins: int, asks: np.ndarray) -> np.ndarray:
    """The least value of each bin, with empty bins filled; ``hashes`` is not empty."""
    least = np.full(bins, _EMPTY, dtype=np.uint64)
    np.minimum.at(least, (hashes % np.uint64(bins)).astype(np.int64), hashes // np.uint64(bins))
    filled = least != _EMPTY
    empty = np.flatnonzero(~filled)
    if len(empty):
        out = least.copy()
        hits = filled[asks[empty]]
        first = hits.argmax(axis=1)
        out[empty] = least[asks[empty, first]]
        for i in empty[~hits.any(axis=1)]:  # few bins are filled: go on around the circle
            at = np.flatnonzero(filled)
            out[i] = least[at[np.searchsorted(at, i) % len(at)]]
        # the borrowed value differs from bin to bin, else one lucky shingle would count many times
        out[empty] = mix(out[empty] + empty.astype(np.uint64))
        return out
    return least


def pack(values: np.ndarray, bits: int) -> str:
    """Low ``bits`` bits of each value, packed, as hexadecimal text."""
    low = mix(values) & np.uint64((1 << bits) - 1)
    return np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)).tobytes().hex()


def fingerprints(texts: list[str | None], bins: int = BINS, bits: int = BITS) -> list[str]:
    asks = donors(bins)
    return [pack(sketch(h, bins, asks), bits) if len(h) else "" for h in text_shingles(texts)]


def likeness(a: str, b: str, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated share of common shingles: agreeing bins, less what agrees by chance, within 0 to 1."""
    if not a or not b:
        return float(a == b)
    unpacked = [np.unpackbits(np.frombuffer(bytes.fromhex(x), dtype=np.uint8))[: bins * bits].reshape(bins, bits) for x in (a, b)]
    same = float((unpacked[0] == unpacked[1]).all(axis=1).mean())
    chance = 2.0**-bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """``docs`` and the fingerprint of each text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def of(texts):
        import pandas as pd

        return pd.Series(fingerprints(texts.tolist(), bins, bits))

    return docs.withColumn(name, of(F.coalesce(F.col(text_col), F.lit(""))))


def in_order_with_next(docs: DataFrame, id_col: str, text_col: str, per_task: int = 4) -> DataFrame:
    """(block, tail, id, text) laid out so that each block is one run of rows of one task, in order of
    (id, text), null ids first. Each block ends with a copy of the first row of the next filled block
    (``tail``), the last one with a copy of the very first row. The texts move once.

    Blocks are ranges of ids between approximate quantiles, so ids of any distribution are spread;
    rows of one id stay together. The driver sees the block borders and the first id of each block.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = per_task * tasks(spark)
    cuts = sorted(set(rows.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n)))
    block = F.lit(0)
    if cuts:
        borders = F.array(*[F.lit(int(c)) for c in cuts])
        # the number of borders at or below the id; null ids come first
        block = F.coalesce(F.aggregate(borders, F.lit(0), lambda k, c: k + F.when(F.col("id") >= c, 1).otherwise(0)), F.lit(0))
    placed = rows.withColumn("block", block)
    first = {r.block: r.id for r in placed.groupBy("block").agg(F.expr("min(struct(id is not null, id)).id").alias("id")).collect()}
    filled = sorted(first)
    if not filled:
        return placed.select("block", F.lit(False).alias("tail"), "id", "text")
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    ends = F.create_map(*[F.lit(x) for b in filled for x in (b, before[b])])
    heads = F.create_map(*[F.lit(x) for b in filled if first[b] is not None for x in (b, first[b])]) if any(v is not None for v in first.values()) else None
    is_head = F.col("id").eqNullSafe(heads[F.col("block")]) if heads is not None else F.col("id").isNull()
    places = F.when(is_head, F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("tail")), F.struct(ends[F.col("block")].alias("block"), F.lit(True).alias("tail")))) \
        .otherwise(F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("tail"))))
    return (
        placed.select(F.explode(places).alias("to"), "id", "text").select("to.block", "to.tail", "id", "text")
        .repartition(tasks(spark), "block").sortWithinPartitions("block", "tail", F.asc_nulls_first("id"), "text")
    )


def edited_text(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and their likeness, also to the next row.

    Rows of one id are ordered by text; the last row's next is the first; a lone row is its own next.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: tuple | None = None  # the row whose follower is still to come

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            prints = fingerprints([r[2] for r in rows], bins, bits)
            edits = [edited_text(r[2], r[3]) for r in rows]
            changed, following = fingerprints(edits, bins, bits), [""] * len(rows)
            later = [i for i in range(len(rows)) if i + 1 == len(rows) or rows[i + 1][2] != rows[i][3]]
            for i, p in zip(later, fingerprints([rows[i][3] for i in later], bins, bits), strict=True):
                following[i] = p
            for i in set(range(len(rows))) - set(later):
                following[i] = prints[i + 1]
            return pa.RecordBatch.from_arrays([
                pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()),
                pa.array([sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edits]), pa.array(prints, pa.string()), pa.array(changed, pa.string()),
                pa.array([likeness(a, b, bins, bits) for a, b in zip(prints, changed, strict=True)], pa.float64()),
                pa.array([likeness(a, b, bins, bits) for a, b in zip(prints, following, strict=True)], pa.float64()),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            ready, held = [], 0
            for block, tail, key, text in zip(*[batch.column(c).to_pylist() for c in ("block", "tail", "id", "text")], strict=True):
                if pending is not None and pending[0] == block:
                    ready.append((*pending, text))
                    held += len(pending[2])
                # of several rows with the id that heads the next block, only the first counts
                pending = None if tail else (block, key, text)
                if held > 1 << 22:
                    yield emit(ready)
                    ready, held = [], 0
            if ready:
                yield emit(ready)

    small_batches(docs.sparkSession)
    laid = in_order_with_next(docs, id_col, text_col)
    out = laid.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
