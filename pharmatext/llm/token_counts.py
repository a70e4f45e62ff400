"""Token counts of whole texts by a byte-level BPE file, without moving a single pre-token.

Two tiers, both on the map side. A bounded table of frequent pre-tokens and their token counts is
broadcast; what it lacks goes through a cache that each worker keeps, and is encoded by the library
only when that cache misses too. The tables only save work: every count is the library's.

Nulls and empty texts have 0 tokens. Repeated rows are counted each. Only ``id_col`` and the text
column are read, so further columns of any name don't matter.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from pharmatext.llm.storage import small_batches
from pharmatext.llm.words import process_wide

#: The split pattern of byte-level BPE files, with the white space that their library knows.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Bounds of the two tiers (entries) and of the rows from which the first is learned.
FREQUENT, CACHED, SAMPLE_ROWS, SAMPLE_TOP = 1 << 16, 1 << 17, 20_000, 1 << 14


def special_strings(model_path: str) -> list[str]:
    with open(model_path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = spec["pre_tokenizer"] or {}
    plain = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
    odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if not plain or spec["normalizer"] or odd:
        raise ValueError("only byte-level BPE files without normalizer and with plain special tokens")
    return sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)


class TokenCounter:
    """Counts tokens of texts: broadcast table first, then this worker's cache, then the library."""

    def __init__(self, model_path: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model_path)
        self.words = regex.compile(PATTERN)
        special = special_strings(model_path)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.frequent, self.cache = frequent, {}

    def _encode(self, words: list[str]) -> None:
        if len(self.cache) + len(words) > CACHED:
            self.cache.clear()
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.cache[w] = len(e)

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The text's pre-tokens, and how many special strings it holds."""
        if self.special is None or not self.special.search(text):
            return self.words.findall(text), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.words.findall(p)], len(parts) - 1

    def count(self, text: str) -> int:
        words, total = self.pieces(text)
        found = list(map(self.frequent.get, words))
        if None in found:
            missed = [w for w, n in zip(words, found, strict=True) if n is None]
            lengths = list(map(self.cache.get, missed))
            if None in lengths:
                self._encode(list({w for w, n in zip(missed, lengths, strict=True) if n is None}))
                # a text with more new words than the cache holds has just put all of them in
                lengths = list(map(self.cache.get, missed))
                if None in lengths:  # the cache was emptied under words it had before
                    self._encode(list(set(missed)))
                    lengths = list(map(self.cache.get, missed))
            total += sum(lengths) + sum(n for n in found if n is not None)
        else:
            total += sum(found)
        return total


def in_worker(model_path: str, frequent: dict[str, int]) -> TokenCounter:
    """The counter of this worker process: it and its cache outlive the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
    counter = process_wide(f"counter of {model_path}", lambda: TokenCounter(model_path, frequent))
    counter.frequent = frequent
    return counter


def frequent_lengths(docs: DataFrame, model_path: str, text_col: str = "text") -> dict[str, int]:
    """Token counts of frequent pre-tokens: each task's commonest of about ``SAMPLE_ROWS`` rows, at
    most ``FREQUENT`` in all. Which words are in it changes only the speed."""

    def commonest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = in_worker(model_path, {}), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(counter.pieces(text or "")[0])
                if len(seen) > 4 * SAMPLE_TOP:
                    seen = Counter(dict(seen.most_common(SAMPLE_TOP)))
        top = [(w, n) for w, n in seen.most_common(SAMPLE_TOP) if len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))  # rows picked where they lie: nothing moves
    sample = docs.select(text_col) if share == 1.0 else docs.select(text_col).sample(share, seed=1)
    top = (
        sample.mapInArrow(commonest, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    )
    counter = TokenCounter(model_path, {})
    return {r.word: counter.count(r.word) for r in top}


def token_counts(docs: DataFrame, model_path: str, max_tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; one scan, no exchange."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(frequent_lengths(narrow, model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or in_worker(model_path, known.value)
            texts = batch.column("text").to_pylist()
            n_bytes = [len((t or "").encode()) for t in texts]
            n_tokens = [counter.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > max_tokens for n in n_tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
