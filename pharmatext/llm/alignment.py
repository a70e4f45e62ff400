"""Alignment of the tokens of two tokenizers by pointer jumping.

Every text is encoded twice, by a byte-level BPE file (A) and by a SentencePiece file (B), and each token is
a range of the bytes of a blank and the text. Two tokens overlap if their ranges share a byte. Every token
points to the farthest-right token that it overlaps with (of two that end together, the one of A); squaring
these pointers until nothing moves leads every token of a connected component to the component's last
token of A, which labels the group. All texts of a batch go through the rounds together.

A link is a token of A and one of B that end at the same byte; each group ends with one. Links are counted
for each pair of ids over the whole table: per task and batch first, then by one aggregation. The counted
pairs go back to the texts in a broadcast table while they are few enough (``MAX_PAIRS``), else by a join.

Texts that are null or empty, or whose tokens' bytes aren't a blank and the text (a normalising file, say),
have no tokens: zeros and ''. Repeated rows count each; an empty table gives no rows. Only the id and text columns
are read, so further columns of any name don't matter; null ids stay null.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from pharmatext.llm.storage import small_batches, written
from pharmatext.llm.token_counts import PATTERN, special_strings
from pharmatext.llm.words import chunks, process_wide

#: Most pairs of ids in the broadcast table (24 bytes each); a larger table is joined.
MAX_PAIRS = 1 << 21
#: Distinct pairs that a task holds while it counts.
HELD_PAIRS = 1 << 20
_ALIGNED = "row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_of_sign() -> dict[str, int]:
    """Byte-level BPE files write bytes as visible signs: printable Latin-1 as itself, others from U+0100 up."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """Ids of texts by a byte-level BPE file, and the bytes of each id."""

    #: Up to U+024F all libraries know the same letters, digits and white space.
    FAST = regex.compile(r"[\x00-ɏ]*")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        special_strings(path)  # refuses files of another kind
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_of_sign()
        special = {t["id"] for t in spec["added_tokens"]}
        vocabulary = {w: i for w, i in spec["model"]["vocab"].items() if i not in special}
        self.bytes = [b""] * (1 + max([*vocabulary.values(), *special]))
        for word, i in vocabulary.items():
            self.bytes[i] = bytes(signs[c] for c in word)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ids = [vocabulary["".join(m)] for m in merges]
        # where ids ascend with the merges, the ids alone say which merge comes first
        self.fast = None
        if ids == sorted(set(ids)) and len(ids) + 256 == len(vocabulary):
            ranks = {w: i for i, w in enumerate(self.bytes) if i not in special}
            self.fast = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and self.FAST.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.int32)


class PieceTokens:
    """Ids of texts by a SentencePiece file, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        self.bytes = [
            bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
            for i in range(sp.get_piece_size())]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, num_threads=1), dtype=np.int32)


def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n-1 (a place more than the longest needs), and how many each has."""
    words = [str(i).encode() for i in range(n)]
    sizes = np.array([len(w) for w in words])
    table = np.zeros((n, sizes.max() + 1), dtype=np.uint8)
    for size in range(1, sizes.max() + 1):
        some = np.flatnonzero(sizes == size)
        if len(some):
            table[some, :size] = np.frombuffer(b"".join(words[i] for i in some), dtype=np.uint8).reshape(-1, size)
    return table, sizes


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, int]:
    """Label of every token (those of A, then those of B) and the rounds it took. Tokens are given by
    their ascending ends over the same bytes; labels are places of tokens of A that end groups."""
    n, m = len(ends_a), len(ends_b)
    pointer = np.arange(n + m, dtype=np.int64)
    if not n or not m:
        return pointer, 0
    # the token at a byte is found by place, since the tokens of each side cover all bytes
    at_a = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends_a, prepend=0))
    at_b = np.repeat(np.arange(m, dtype=np.int32), np.diff(ends_b, prepend=0))
    over_a, over_b = at_b[ends_a - 1], at_a[ends_b - 1]  # the token of the other side at a token's last byte
    pointer[:n] = np.where(ends_b[over_a] > ends_a, n + over_a, pointer[:n])
    pointer[n:] = over_b  # it ends no earlier
    rounds = 0
    while True:
        further = pointer[pointer]
        rounds += 1
        if np.array_equal(further, pointer):
            return pointer, rounds
        pointer = further


class Aligner:
    """Aligns batches of texts; one for each worker process."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        self.length_a = np.array([len(w) for w in self.a.bytes])
        self.length_b = np.array([len(w) for w in self.b.bytes])
        self.digits, self.sizes = decimals(max(len(self.a.bytes), len(self.b.bytes)))

    def _encoded(self, texts: list[str | None], side) -> list[np.ndarray]:
        none = np.empty(0, dtype=np.int32)
        return [side.ids(" " + t if side is self.a else t) if t else none for t in texts]

    def align(self, texts: list[str | None]):
        """Per text: tokens of A and of B, groups, the groups' hash; and of all links the ids, and their bounds by text."""
        a, b = self._encoded(texts, self.a), self._encoded(texts, self.b)
        for i, text in enumerate(texts):
            if text:
                raw = b" " + text.encode("utf-8", "surrogatepass")
                if any(b"".join(map(side.bytes.__getitem__, ids.tolist())) != raw for side, ids in ((self.a, a[i]), (self.b, b[i]))):
                    a[i] = b[i] = a[i][:0]
        n_a, n_b = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
        ids_a, ids_b = np.concatenate([*a, np.empty(0, np.int32)]), np.concatenate([*b, np.empty(0, np.int32)])
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        labels, _ = terminals(ends_a, ends_b)
        last_a = np.flatnonzero(labels[: len(ids_a)] == np.arange(len(ids_a)))  # the last tokens of A, group by group
        group = np.zeros(len(ids_a), dtype=np.int64)
        group[last_a] = np.arange(len(last_a))
        group_a, group_b = group[labels[: len(ids_a)]], group[labels[len(ids_a):]]
        per_a, per_b = np.bincount(group_a, minlength=len(last_a)), np.bincount(group_b, minlength=len(last_a))
        before_a, before_b = np.cumsum(per_a) - per_a, np.cumsum(per_b) - per_b
        last_b = before_b + per_b - 1
        bounds_a = np.concatenate([[0], np.cumsum(n_a)])
        bounds = np.searchsorted(last_a, bounds_a)  # of the groups, and so of the links, by text
        hashes = self._hashes(ids_a, ids_b, group_a, group_b, per_a, before_a, before_b, last_a, last_b, bounds_a, n_a + n_b)
        return n_a, n_b, bounds, hashes, ids_a[last_a], ids_b[last_b]

    def _hashes(self, ids_a, ids_b, group_a, group_b, per_a, before_a, before_b, last_a, last_b, bounds_a, n_tokens) -> list[str]:
        """SHA-256 of each text's groups, written as ``a1,a2|b1;a3|b2,b3``."""
        place_a = np.arange(len(ids_a)) + before_b[group_a]
        place_b = np.arange(len(ids_b)) + (before_a + per_a)[group_b]
        tokens = np.empty(len(ids_a) + len(ids_b), dtype=np.int32)
        tokens[place_a], tokens[place_b] = ids_a, ids_b
        signs = np.full(len(tokens), ord(","), dtype=np.uint8)
        signs[place_a[last_a]], signs[place_b[last_b]] = ord("|"), ord(";")
        ends = np.cumsum(n_tokens)
        sizes = self.sizes[tokens]
        written_to = sizes + 1
        written_to[ends[n_tokens > 0] - 1] -= 1  # no sign behind a text's last token
        out = np.concatenate([[0], np.cumsum(written_to)])[np.concatenate([[0], ends])]
        cells = self.digits[tokens]
        cells[np.arange(len(tokens)), sizes] = signs
        raw = cells[np.arange(cells.shape[1]) < written_to[:, None]].tobytes()
        return [hashlib.sha256(raw[s:e]).hexdigest() if e > s else "" for s, e in zip(out[:-1].tolist(), out[1:].tolist(), strict=True)]


def _distinct_links(a: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of each text, how often each is linked there, and the bounds by text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair = (a.astype(np.int64) << 32) | b
    order = np.lexsort((pair, text))
    pair, text = pair[order], text[order]
    new = np.ones(len(pair), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(pair)))
    pair = pair[first]
    return (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32), np.searchsorted(text[first], np.arange(len(bounds)))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: its numbers, the hash of its groups, and its distinct links (a, b, n) as arrays."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lists = lambda values, bounds: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        aligner = process_wide(f"aligner of {byte_path} {piece_path}", lambda: Aligner(byte_path, piece_path))
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s, e in chunks(texts):
                n_a, n_b, bounds, hashes, a, b = aligner.align(texts[s:e])
                groups = np.diff(bounds)
                a, b, n, cuts = _distinct_links(a, b, bounds)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + e - s)), batch.column("id").slice(s, e - s), pa.array(n_a), pa.array(n_b),
                    pa.array(groups.astype(np.int64)), pa.array(groups.astype(np.int64)), pa.array(hashes, pa.string()),
                    lists(a, cuts), lists(b, cuts), lists(n, cuts),
                ], names=["row", "id", *_COUNTS, "groups_sha256", "a", "b", "n"])
                row += e - s

    return rows.mapInArrow(work, _ALIGNED.format(kind=rows.schema["id"].dataType.simpleString()))


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _pairs_of(batch: pa.RecordBatch) -> np.ndarray:
    return (_flat(batch.column("a")).astype(np.int64) << 32) | _flat(batch.column("b"))


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best) over the whole table: how many links hold the pair, and whether no pair of
    its b has more. Tasks add up their own pairs first, so a frequent pair costs each task a row at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = (np.empty(0, np.int64), np.empty(0, np.int64)), []

        def merged():
            keys, at = np.unique(np.concatenate([held[0], *[k for k, _ in fresh]]), return_inverse=True)
            total = np.zeros(len(keys), dtype=np.int64)
            np.add.at(total, at, np.concatenate([held[1], *[n for _, n in fresh]]))
            return keys, total

        def rows(keys, total):
            for s in range(0, len(keys), 1 << 16):
                k = keys[s:s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([
                    pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(total[s:s + (1 << 16)])], names=["a", "b", "count"])

        waiting = 0
        for batch in batches:
            fresh.append((_pairs_of(batch), _flat(batch.column("n")).astype(np.int64)))
            waiting += len(fresh[-1][0])
            if waiting > HELD_PAIRS:
                held, fresh, waiting = merged(), [], 0
                if len(held[0]) > HELD_PAIRS:
                    yield from rows(*held)
                    held = (held[0][:0], held[1][:0])
        yield from rows(*merged())

    total = links.select("a", "b", "n").mapInArrow(count, "a int, b int, count long").groupBy("a", "b").agg(F.sum("count").alias("count"))
    total = written(total, "pairs")
    most = total.groupBy("b").agg(F.max("count").alias("most"))  # one row for each id of B
    return written(total.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "best-pairs")


def _looked_up(links: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """(id, numbers.., n_best, count_sum) by a table of pairs in every worker."""
    found = pairs.select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("k"), "count", "best").toArrow()
    order = np.argsort(keys := found["k"].to_numpy())
    table = links.sparkSession.sparkContext.broadcast((keys[order], found["count"].to_numpy()[order], found["best"].to_numpy()[order]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, best = table.value
            at = np.searchsorted(keys, _pairs_of(batch))
            n = _flat(batch.column("n")).astype(np.int64)
            size = pc.list_value_length(batch.column("a")).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.cumsum(size)])
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n * best[at], n * counts[at])]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("id", *_COUNTS)], *[pa.array((x[cuts[1:]] - x[cuts[:-1]]).astype(np.int64)) for x in sums], batch.column("groups_sha256"),
            ], names=["id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])

    numbers = ", ".join(f"{c} long" for c in (*_COUNTS, "n_best", "count_sum"))
    return links.select("id", *_COUNTS, "groups_sha256", "a", "b", "n").mapInArrow(look, f"id {kind}, {numbers}, groups_sha256 string")


def _joined(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same by a join on the pair: the way out for any number of pairs."""
    each = links.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("row", "x.a", "x.b", "x.n")
    sums = each.join(pairs, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return links.join(sums, "row", "left").select("id", *_COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256")


def alignment(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    links = written(aligned(docs, byte_path, piece_path, id_col, text_col), "aligned")
    pairs = pair_counts(links)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    out = _looked_up(links, pairs, kind) if pairs.count() <= max_pairs else _joined(links, pairs)
    return out.withColumnRenamed("id", id_col)
