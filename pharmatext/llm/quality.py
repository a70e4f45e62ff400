"""Quality by importance resampling: target against raw text, sampled by Gumbel top-k.

Two generative models of hashed n-grams are counted: one of the target (rows labelled good, of a
bounded sample of labelled rows), one of the raw text (all rows, in the same scan, which moves no text). The n-grams are words and signs, pairs of them, and triples of
their shapes (lower case, capital, upper case, digits, which sign, whether it repeats one of the two
before). A row's log ratio is the sum of ``ln(p_target / p_raw)`` over its n-grams; per n-gram it is
compared with a cut that separates the sample of labelled rows best.

The log weight of a row is ``sharpness * n * (log ratio per n-gram - cut)``. Each row's weight gets
Gumbel noise (a digest of its id), and the k largest are taken, where k is the number of rows above
the cut: a sample without replacement with chances that follow the weights. Rows far from the cut are
thus taken or left for sure, only those near it by chance. Rows without any token (null, empty or
blank texts) are never taken. Equal rows fare alike. Without labels of both kinds all rows with a
token are taken. Ties at the last key are all taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pharmatext.llm.counting import summed
from pharmatext.llm.storage import fresh, scratch, small_batches, written
from pharmatext.llm.words import chunks, mix, token_runs

BITS = 15
SIZE = 3 << BITS
#: Labelled rows that the target model and the cut are fitted on, at most about so many.
LABELLED_ROWS = 50_000
SHARPNESS = 8.0


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of the texts: words, pairs and shape triples have a third of the buckets each."""
    hashes, shapes, bounds = token_runs(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    n = len(hashes)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    same1, same2 = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    same1[1:] = text[1:] == text[:-1]
    same2[2:] = text[2:] == text[:-2]
    before1, before2 = np.roll(hashes, 1), np.roll(hashes, 2)
    repeats = (same1 & (hashes == before1)).astype(np.uint64) + np.uint64(2) * (same2 & (hashes == before2)).astype(np.uint64)
    shape = mix(shapes * np.uint64(4) + repeats)
    start = np.uint64(7)
    pair = mix(hashes + np.where(same1, before1, start) * np.uint64(0x9E3779B97F4A7C15))
    s1, s2 = np.where(same1, np.roll(shape, 1), start), np.where(same2, np.roll(shape, 2), start)
    triple = mix(shape + mix(s1 + mix(s2)))
    shift = np.uint64(64 - BITS)
    bucket = np.concatenate([(h >> shift).astype(np.int64) + (k << BITS) for k, h in enumerate((hashes, pair, triple))])
    return np.tile(text, 3), bucket


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """ln(p_target / p_raw) of every bucket, each third being a model of its own."""
    out = np.zeros(SIZE)
    for k in range(3):
        part = slice(k << BITS, (k + 1) << BITS)
        t, r = target[part] + 1.0, raw[part] + 1.0
        out[part] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def score(texts: list[str | None], ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams of each text, and its mean log ratio (0 without any)."""
    counts, sums = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    for a, b in chunks(texts):
        text, bucket = ngrams(texts[a:b])
        counts[a:b] = np.bincount(text, minlength=b - a)
        sums[a:b] = np.bincount(text, weights=ratios[bucket], minlength=b - a)
    return counts, sums / np.maximum(counts, 1)


def _labelled(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """(_id, _label) of about ``LABELLED_ROWS`` labelled ids at most, picked by a digest; an id with both labels is left out."""
    marked = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("int").alias("_label"), F.max(label_col).alias("_most"))
    marked = marked.filter("_label = _most AND _id IS NOT NULL").select("_id", "_label")
    n = marked.count()
    if n <= LABELLED_ROWS:
        return marked
    digest = F.shiftrightunsigned(F.xxhash64("_id", F.lit("quality")), 1)  # 63 bits: a share of any smallness
    return marked.filter(digest < (LABELLED_ROWS << 63) // n)


def count_models(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of the rows marked good and of all rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(marked.filter("_label = 1")), rows["id"] == F.col("_id"), "left").select("text", F.col("_label").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            texts, good = batch.column("text").to_pylist(), np.array(batch.column("good").to_pylist(), dtype=bool)
            total = np.zeros(2 * SIZE, dtype=np.int64) if total is None else total
            for a, b in chunks(texts):
                text, bucket = ngrams(texts[a:b])
                total[SIZE:] += np.bincount(bucket, minlength=SIZE)
                total[:SIZE] += np.bincount(bucket[good[a:b][text]], minlength=SIZE)
        return total

    total = summed(rows, count, 2 * SIZE)
    return total[:SIZE], total[SIZE:]


def best_cut(values: np.ndarray, labels: np.ndarray, care: float = 2.0) -> float:
    """The cut with the least errors, each kind as a share of its class; to lose a good row counts
    ``care`` times. Of equal cuts the middle one. Minus infinity without both kinds."""
    good, bad = np.sort(values[labels == 1]), np.sort(values[labels == 0])
    if not len(good) or not len(bad):
        return float("-inf")
    points = np.unique(values)
    cuts = (points[1:] + points[:-1]) / 2
    if not len(cuts):
        return float("-inf")
    loss = care * np.searchsorted(good, cuts) / len(good) + 1 - np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


class QualityModel:
    def __init__(self, ratios: np.ndarray, cut: float):
        self.ratios, self.cut = ratios.astype(np.float32), cut


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    small_batches(docs.sparkSession)
    marked = written(_labelled(labels, label_col, id_col), "quality-labels")
    target, raw = count_models(docs, marked, id_col, text_col)
    if not target.any():
        return QualityModel(np.zeros(SIZE), float("-inf"))
    ratios = log_ratios(target, raw)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.join(F.broadcast(marked), rows["id"] == F.col("_id")).select("_label", _score_column(rows, ratios, "text").alias("s"))
    seen = scored.select("_label", "s.*").filter("n > 0").toArrow()
    return QualityModel(ratios, best_cut(np.array(seen.column("mean").to_pylist(), dtype=float), np.array(seen.column("_label").to_pylist())))


def _score_column(docs: DataFrame, ratios: np.ndarray, text_col: str) -> Column:
    """A struct of the number of n-grams and their mean log ratio."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.float32))  # SIZE numbers

    @F.arrow_udf("struct<n: long, mean: double>")
    def scored(texts: pa.Array) -> pa.Array:
        n, mean = score(texts.to_pylist(), shared.value)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(mean, pa.float64())], names=["n", "mean"])

    return scored(F.col(text_col))


def gumbel(seed: int, *parts: Column) -> Column:
    """Standard Gumbel noise that depends on the parts alone."""
    bits = F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def kth_largest(values: DataFrame, column: str, k: int, few: int = 4096) -> float:
    """The k-th largest finite value: counts of ``few`` ranges, and again within the range that holds it."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while True:
        width = (high - low) / few
        held = values.filter(F.col(column).between(low, high))
        if width == 0 or low + width == low:
            return low
        counts = {r.b: r.n for r in held.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(few - 1)).alias("b")).agg(F.count("*").alias("n")).collect()}
        if sum(counts.values()) <= few:
            return sorted((r[0] for r in held.select(column).collect()), reverse=True)[k - 1]
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                low, high = low + b * width, (high if b == few - 1 else float(np.nextafter(low + (b + 1) * width, -np.inf)))
                break
            k -= counts[b]
        ends = values.filter(F.col(column).between(low, high)).agg(F.min(column), F.max(column)).first()
        if ends[0] is None:  # rounding put the last value just outside
            return low
        low, high = ends


def _with_keys(docs: DataFrame, model: QualityModel, seed: int, sharpness: float, id_col: str, text_col: str, prefix: str) -> DataFrame:
    """``docs`` with (n_ngrams, log_ratio, log_weight, key): the key is the weight with its Gumbel noise."""
    small_batches(docs.sparkSession)
    s = F.col(f"{prefix}scored")
    scored = docs.withColumn(f"{prefix}scored", _score_column(docs, model.ratios, text_col))
    cut = model.cut if np.isfinite(model.cut) else -1e3
    scored = scored.withColumn(f"{prefix}n_ngrams", s["n"]).withColumn(f"{prefix}log_ratio", s["mean"])
    scored = scored.withColumn(f"{prefix}log_weight", F.when(s["n"] > 0, sharpness * s["n"] * (s["mean"] - cut))).drop(f"{prefix}scored")
    noise = gumbel(seed, F.col(id_col), F.xxhash64(text_col))
    return scored.withColumn(f"{prefix}key", F.col(f"{prefix}log_weight") + noise)


def _least_key(scored: DataFrame, prefix: str) -> float:
    """The key from which on rows are taken."""
    keys = scored.select(F.col(f"{prefix}key").alias("key"), F.col(f"{prefix}log_weight").alias("w")).filter("key IS NOT NULL")
    k = keys.filter("w > 0").count()
    return kth_largest(keys, "key", k) if k else float("inf")


def _taken(prefix: str, least: float) -> Column:
    return F.coalesce(F.col(f"{prefix}key") >= least, F.lit(False))


def with_sample(docs: DataFrame, model: QualityModel, seed: int = 3, sharpness: float = SHARPNESS, id_col: str = "doc_id", text_col: str = "text", prefix: str = "", drop_text: bool = False) -> DataFrame:
    """``docs`` with (n_ngrams, log_ratio, log_weight, kept), stored once (without the texts on request)."""
    scored = _with_keys(docs, model, seed, sharpness, id_col, text_col, prefix)
    scored = written(scored.drop(text_col) if drop_text else scored, "quality")
    return scored.withColumn(f"{prefix}kept", _taken(prefix, _least_key(scored, prefix))).drop(f"{prefix}key")


def kept_rows(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are taken, with their columns. Only keys are stored to find the border;
    the rows are scored again where they lie, so no text is written twice."""
    prefix = fresh(docs, "_quality_")
    scored = _with_keys(docs, model, 3, SHARPNESS, id_col, text_col, prefix)
    with scratch(docs.sparkSession):
        least = _least_key(written(scored.select(f"{prefix}key", f"{prefix}log_weight"), "quality"), prefix)
    return scored.filter(_taken(prefix, least)).select(*[F.col(f"`{c}`") for c in docs.columns])
