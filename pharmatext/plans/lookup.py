"""Word look-up inside Arrow batches, for word tables small enough to be in every Python worker.

Joining a text's tokens with a table and putting the text together again costs a shuffle of all
tokens. A table that is measured to be small goes to the workers once, and each batch of token
arrays is looked up in place: no shuffle, and no Python object per token. Of a larger table the first
words go to the workers, and only the tokens that are none of these are joined with the rest of it. Word files begin
with their most frequent words; where one does not, the rows are the same and more tokens travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LOOKUP_BYTES = 128 * 1024 * 1024


def worker_table(table: DataFrame):
    """Broadcast ``(terms, idx, matrix)`` of a word table whose size has been checked.

    Row -1 of the matrix is a zero vector, for unknown words.
    """
    found = table.select("term", "idx", "vec").toArrow().combine_chunks()
    n = len(found)
    if not n:
        return table.sparkSession.sparkContext.broadcast((pa.array([], pa.string()), np.zeros(0, np.int64), None))
    matrix = found["vec"].combine_chunks().flatten().to_numpy().astype(np.float32).reshape(n, -1)
    matrix = np.vstack([matrix, np.zeros((1, matrix.shape[1]), np.float32)])
    idx = found["idx"].to_numpy().astype(np.int64)
    terms = found["term"].combine_chunks()
    return table.sparkSession.sparkContext.broadcast((terms, idx, matrix))


def worker_words(table: DataFrame):
    """Broadcast ``(terms, idx)`` of a word table whose size has been checked."""
    found = table.select("term", "idx").toArrow().combine_chunks()
    terms = found["term"].combine_chunks() if len(found) else pa.array([], pa.string())
    return table.sparkSession.sparkContext.broadcast((terms, found["idx"].to_numpy().astype(np.int64)))


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and values of a list array."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.flatten()


def rows_of(tokens: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the token lists, and per token its row in the word table or -1."""
    offsets, words = flat_lists(tokens)
    rows = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False)
    return offsets, rows


def map_lists(df: DataFrame, keys: list[str], lists: str, schema: str,
              fn: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """Map a list column batch by batch; ``keys`` pass through, ``schema`` is the new column's."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(batch.column(lists))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], new], names=[*keys, "_new"])

    columns = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return df.select(*keys, lists).mapInArrow(run, f"{columns}, _new {schema}")


def missed_in(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (over all lists) of the entries without a row, and the lists' offsets among them."""
    missed = np.flatnonzero(rows < 0)
    return missed, np.searchsorted(missed, offsets)


def filled(known: pa.Array, places: pa.Array, values: pa.Array) -> pa.Array:
    """Lists with the ``values`` of each list put at its ``places``; a null list of places changes nothing."""
    offsets, flat = flat_lists(known)
    starts, at = flat_lists(places)
    new = flat_lists(values)[1]
    lists = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    take = np.arange(len(flat))
    take[offsets[lists] + at.to_numpy(zero_copy_only=False)] = len(flat) + np.arange(len(new))
    return list_with_offsets(offsets, pa.concat_arrays([flat, new.cast(flat.type)]).take(pa.array(take)))


def map_batches(df: DataFrame, keys: list[str], fn: Callable[[pa.RecordBatch], list[pa.Array]], schema: str) -> DataFrame:
    """``keys`` as they are and the columns of ``schema`` that ``fn`` makes of each batch."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [c.split()[0] for c in schema.replace(", ", ",").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *fn(batch)], names=[*keys, *names])

    return df.mapInArrow(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], schema]))


def list_of_rows(values: np.ndarray) -> pa.Array:
    """A 2-d array as one list per row."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def list_with_offsets(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def mean_of(rows: np.ndarray, matrix: np.ndarray, block: int = 65536) -> np.ndarray:
    """Mean vector of the known rows; zeros if there are none. Long texts go block by block."""
    known = rows[rows >= 0]
    total = np.zeros(matrix.shape[1])
    for start in range(0, len(known), block):
        total += matrix[known[start:start + block]].sum(axis=0, dtype=np.float64)
    return total / max(1, len(known))
