"""Spelling variants of words, found by Bloom-guided neighbourhoods.

Words are counted over whole texts. Two words are near if they differ by exactly one inserted, deleted or
replaced character. Each near pair is generated once, from one side: a pair of different lengths by deleting
a character of the longer word (of equal neighbours only the first), a pair of equal lengths by replacing a
character by a smaller one of the vocabulary's alphabet. A generated word goes on only if a Bloom filter may
hold it: one for each word length, cut into shards of at most ``SHARD_BYTES``, each made of 64-bit blocks with
the bits of a word in one block. Shards are broadcast ``ROUND_BYTES`` at a time, so a larger vocabulary
takes more rounds rather than more memory. What passes meets the vocabulary in an equi-join, which removes false positives.

A word's form is its near word of largest count (ties: the smallest in code-point order) if that has at least ``RATIO``
times the word's count. Counts grow with every step from form to form, so pointers to the last one are
doubled a few times only.

A run is of letters A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only. Where ``thinned`` divides the
CRC-32 of ``<id>:<run>``, the run loses the character at that number modulo its length. Null texts have no runs, a null id reads as empty; repeated
rows count each; an empty table gives no rows. Only the id and text columns are read, so further columns of any name don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pharmatext.llm.storage import small_batches, tasks, written
from pharmatext.llm.words import mix

MIN_LENGTH, MIN_COUNT, RATIO, THINNED = 7, 2, 10, 31
#: Bits of filter for each word, the most bytes of a shard, and the most bytes broadcast at a time.
BITS_PER_WORD, SHARD_BYTES, ROUND_BYTES = 16, 1 << 16, 1 << 26
#: Blocks that any shard has at least: so a few very long words meet hardly any false positive.
LEAST_BLOCKS = 1 << 10
#: Words that a task holds while it counts, and generated words that are looked at together.
HELD_WORDS, GENERATED = 1 << 18, 1 << 20

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(doc_id: int | None, text: str | None, thinned: int = THINNED, min_length: int = MIN_LENGTH) -> Counter:
    """Words of a text of at least ``min_length`` characters, and how often they occur."""
    out: Counter = Counter()
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
        if len(run) >= min_length:
            h = zlib.crc32(run.encode(), seed)
            if h % thinned == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
                if len(run) < min_length:
                    continue
            out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words that occur at least ``MIN_COUNT`` times; tasks add up their own words first."""
    small_batches(docs.sparkSession)

    def rows(held: Counter) -> Iterator[pa.RecordBatch]:
        words, counts = list(held.keys()), list(held.values())
        for s in range(0, len(words), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(words[s:s + (1 << 14)], pa.string()), pa.array(counts[s:s + (1 << 14)], pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in words_of(doc_id, text).items():
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield from rows(held)
                    held.clear()
        yield from rows(held)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, characters) of the words of each length; a character is a byte, all being Latin-1."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        raw = "".join(words[i] for i in places).encode("latin-1")
        yield int(size), places, np.frombuffer(raw, dtype=np.uint8).reshape(len(places), size)


def powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def digests(letters: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each row of characters."""
    if not letters.shape[1]:
        return np.zeros(len(letters), dtype=np.uint64)
    return mix(((letters.astype(np.uint64) + np.uint64(1)) * powers(letters.shape[1])).sum(axis=1, dtype=np.uint64))


def place_and_bits(digest: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each digest, and four bits in it (fewer if they coincide)."""
    block = ((digest >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    bits = np.zeros(len(digest), dtype=np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << (digest >> np.uint64(6 * k) & np.uint64(63))
    return block.astype(np.int64), bits


def parts_of(n: int) -> int:
    """Shards that hold ``n`` words of one length."""
    return max(1, -(-n * BITS_PER_WORD // (8 * SHARD_BYTES)))


def part_of(digest: np.ndarray, parts: int) -> np.ndarray:
    return (mix(digest) % np.uint64(parts)).astype(np.int32)


def blocks_of(n: int) -> int:
    """64-bit blocks of each of the shards that hold ``n`` words."""
    return max(LEAST_BLOCKS, -(-n * BITS_PER_WORD // (64 * parts_of(n))))


def shards(words: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(length, part, bits) of the filter shards of all words. A group is one shard: its size is bounded."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, letters in by_length(batch.column("word").to_pylist()):
                h = digests(letters)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(h), size, np.int32)), pa.array(part_of(h, parts_of(sizes[size]))), pa.array(h.view(np.int64))], names=["length", "part", "digest"])

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size, part = (k.as_py() for k in key)
        filled = np.zeros(blocks_of(sizes[size]), dtype=np.uint64)
        block, bits = place_and_bits(table.column("digest").to_numpy().view(np.uint64), len(filled))
        np.bitwise_or.at(filled, block, bits)
        return pa.table({"length": pa.array([size], pa.int32()), "part": pa.array([part], pa.int32()), "bits": pa.array([filled.tobytes()], pa.binary())})

    return words.select("word").mapInArrow(place, "length int, part int, digest long").groupBy("length", "part").applyInArrow(build, "length int, part int, bits binary")


class Neighbourhood:
    """Generates the smaller neighbours of words and asks the shards of this round for them."""

    def __init__(self, alphabet: list[int], sizes: dict[int, int], known: dict[tuple[int, int], bytes]):
        self.alphabet = np.array(sorted(alphabet), dtype=np.uint8)
        self.parts = {size: parts_of(n) for size, n in sizes.items()}
        self.shards = {k: np.frombuffer(v, dtype=np.uint64) for k, v in known.items()}
        self.lengths = {size for size, _ in known}

    def _may_hold(self, size: int, h: np.ndarray) -> np.ndarray:
        """Whether a shard of this round may hold words of ``size`` characters with these digests."""
        part = part_of(h, self.parts[size]) if self.parts[size] > 1 else None
        out = np.zeros(len(h), dtype=bool)
        for p in range(self.parts[size]):
            shard = self.shards.get((size, p))
            if shard is not None:
                some = slice(None) if part is None else np.flatnonzero(part == p)
                block, bits = place_and_bits(h[some], len(shard))
                out[some] = shard[block] & bits == bits
        return out

    def found(self, size: int, letters: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
        """(rows, neighbours that may be words) of words of ``size`` characters each."""
        if size not in self.lengths and size - 1 not in self.lengths:
            return
        step = max(1, GENERATED // (size * max(1, len(self.alphabet))))
        span = max(1, GENERATED // max(1, len(self.alphabet)))  # positions at a time, for very long words
        for s in range(0, len(letters), step):
            some = letters[s:s + step]
            power = powers(size)
            cells = (some.astype(np.uint64) + np.uint64(1)) * power
            sums = np.zeros((len(some), size + 1), dtype=np.uint64)
            np.cumsum(cells, axis=1, dtype=np.uint64, out=sums[:, 1:])
            if size - 1 in self.lengths:
                first = np.ones(some.shape, dtype=bool)
                first[:, 1:] = some[:, 1:] != some[:, :-1]
                row, at = np.nonzero(first)
                h = mix(sums[row, at] + (sums[row, -1] - sums[row, at + 1]) * np.uint64(_INVERSE))
                hit = np.flatnonzero(self._may_hold(size - 1, h))
                yield from self._words(s, some, row[hit], at[hit], None)
            if size in self.lengths:
                for a in range(0, size, span):
                    # letters of the alphabet that are smaller than the one in their place
                    row, at, new = np.nonzero(self.alphabet[None, None, :] < some[:, a:a + span, None])
                    at += a
                    sign = self.alphabet[new]
                    change = (sign.astype(np.uint64) - some[row, at].astype(np.uint64)) * power[at]
                    hit = np.flatnonzero(self._may_hold(size, mix(sums[row, -1] + change)))
                    yield from self._words(s, some, row[hit], at[hit], sign[hit])

    @staticmethod
    def _words(start: int, letters: np.ndarray, row: np.ndarray, at: np.ndarray, sign: np.ndarray | None) -> Iterator[tuple[np.ndarray, list[str]]]:
        """The edited words themselves, about a megabyte of them at a time."""
        size = letters.shape[1]
        step = max(1, (1 << 20) // size)
        for s in range(0, len(row), step):
            r, i = row[s:s + step], at[s:s + step]
            cells = letters[r]
            if sign is None:
                cells = cells[np.arange(size) != i[:, None]].reshape(len(r), size - 1)
            else:
                cells[np.arange(len(r)), i] = sign[s:s + step]
            text, width = cells.tobytes().decode("latin-1"), cells.shape[1]
            yield r + start, [text[k:k + width] for k in range(0, len(text), width)]


def rounds_of(sizes: dict[int, int], round_bytes: int) -> list[set[tuple[int, int]]]:
    """Shards dealt to rounds of at most ``round_bytes`` (one shard at least)."""
    out: list[set[tuple[int, int]]] = []
    left = 0
    for size, n in sorted(sizes.items()):
        for part in range(parts_of(n)):
            need = 8 * blocks_of(n)
            if need > left or not out:
                out.append(set())
                left = round_bytes
            out[-1].add((size, part))
            left -= need
    return out


def _signs(words: DataFrame) -> list[int]:
    """The vocabulary's alphabet: of Latin-1, so 90 letters at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            seen.update("".join(batch.column("word").to_pylist()).encode("latin-1"))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], names=["sign"])

    return [r.sign for r in words.select("word").mapInArrow(work, "sign int").distinct().collect()]


def candidates(words: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, near): generated neighbours that the filters let pass, true ones all among them."""
    spark = words.sparkSession
    sizes = {r.size: r.n for r in words.groupBy(F.length("word").alias("size")).agg(F.count("*").alias("n")).collect()}
    alphabet = _signs(words)
    filters = written(shards(words, sizes), "filter-shards")
    out = None
    for wanted in rounds_of(sizes, round_bytes):
        lengths = sorted({size for size, _ in wanted})
        low, high = min(wanted), max(wanted)  # shards of a round follow each other
        key = F.struct("length", "part")
        part = filters.filter((key >= F.struct(F.lit(low[0]).alias("length"), F.lit(low[1]).alias("part"))) & (key <= F.struct(F.lit(high[0]).alias("length"), F.lit(high[1]).alias("part"))))
        known = spark.sparkContext.broadcast({(r.length, r.part): bytes(r.bits) for r in part.collect()})  # at most round_bytes

        def generate(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            near = None
            for batch in batches:
                near = near or Neighbourhood(alphabet, sizes, known.value)
                words_, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for size, places, letters in by_length(words_):
                    for row, found in near.found(size, letters):
                        at = places[row]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([words_[i] for i in at], pa.string()), pa.array(counts[at]), pa.array(found, pa.string())], names=["word", "n", "near"])

        reach = words.filter(F.length("word").between(lengths[0], lengths[-1] + 1))
        # files follow the counting's partitions; dealt anew, all tasks generate alike
        passed = reach.repartition(tasks(spark)).mapInArrow(generate, "word string, n long, near string")
        out = passed if out is None else out.unionByName(passed)
    return out if out is not None else words.select("word", "n", F.col("word").alias("near"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the way from form to form, by doubling pointers."""
    to = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(to.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        to = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return to


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = written(vocabulary(docs, id_col, text_col), "vocabulary")
    passed = candidates(words, round_bytes)
    met = passed.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    pairs = written(met.select("word", "n", "near", "near_n"), "near-words")
    both = pairs.select("word").unionByName(pairs.select(F.col("near").alias("word")))
    n_near = both.groupBy("word").agg(F.count("*").alias("n_near"))
    larger = lambda a, a_n, b, b_n: pairs.filter(F.col(b_n) >= RATIO * F.col(a_n)).select(F.col(a).alias("word"), F.col(b).alias("form"), F.col(b_n).alias("form_n"))
    ahead = larger("word", "n", "near", "near_n").unionByName(larger("near", "near_n", "word", "n"))
    best = ahead.groupBy("word").agg(F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    forms = written(best.select("word", "best.form", (-F.col("best.less")).alias("form_n")), "forms")
    known = forms.join(last_forms(forms), "word")
    return words.join(n_near, "word", "left").join(known, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
