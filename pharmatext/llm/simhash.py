"""SimHash near-duplicates by anchor-point covering.

A fingerprint bit is 1 if it is set in over half the hashes of a text's three-word shingles. Two
fingerprints are linked if they differ in at most ``threshold`` bits.

The anchors are the words of a covering code: the product of two binary Golay codes on bits 0-22 and 23-45
and of no condition on the other 18. The Golay code is perfect, so each 23 bits lie within 3 bits of
exactly one codeword: that pair of codewords is a fingerprint's home. A fingerprint is replicated to every
anchor within the covering radius plus the threshold, block by block: an anchor whose distances go beyond 3 by at most
``threshold`` bits in all. If x and y differ in that many bits, y is so replicated to x's home. Fingerprints at
home at an anchor are then compared with all replicas there, by one equi-join on the anchor.

Only distinct fingerprints take part, so copies cost nothing. An anchor that is home to more than ``CROWDED``
would compare quadratically many; its members (replicas too) are linked through their one-bit neighbours instead: two
fingerprints differ in two bits at most if, and only if, they share a word within one bit of both, and at most 65 fingerprints lie around any word. That is exact, for
thresholds up to 2, so it loses no link and costs 65 rows for each member of a crowded anchor.

Classes are the connected components; a class is named by its least id. Texts without words have fingerprint
0, which is linked like any other; null counts as empty. Repeated rows are in one class; an empty table
gives no rows. Null ids stay null and never name a class, unless there is no other id in it. Only the id and text columns
are read, so further columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pharmatext.llm.components import components
from pharmatext.llm.storage import small_batches, written
from pharmatext.llm.words import chunks, process_wide

THRESHOLD, SEED, SHINGLE = 2, 42, 3
#: Most fingerprints at home at an anchor that are compared one by one with its replicas.
CROWDED = 512
#: Fixed values of the Golay code: length, redundancy, covering radius, generator polynomial.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b101011100011
#: Fingerprints whose replicas are made at a time.
_BLOCK = 1 << 13


def fingerprint(text: str) -> int:
    """Majority bits of the hashes of all three-word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = [0, *(ends[:-1] + 1).tolist()][: max(1, len(words) - SHINGLE + 1)]
    last = ends[min(SHINGLE, len(words)) - 1:].tolist()
    hashed = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, dtype=np.int64), len(first)
    for s in range(0, n, 1 << 16):
        h = np.array([hashed(joined[i:j], SEED) for i, j in zip(first[s:s + (1 << 16)], last[s:s + (1 << 16)], strict=True)], dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * votes > n).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f) of every row, the 64 bits as a signed integer."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s, e in chunks(texts):
                found = np.array([fingerprint(t or "") for t in texts[s:e]], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(s, e - s), pa.array(found.view(np.int64))], names=["id", "f"])

    return rows.mapInArrow(work, "id long, f long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial; words of the code have none."""
    left = words.astype(np.int64, copy=True)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - CHECKS), 0)
    return left


class GolayBalls:
    """For each syndrome the differences of weight up to ``RADIUS + threshold`` that lead to codewords.

    The first of each is the one within the covering radius; ``over`` says by how many bits a
    difference goes beyond that radius.
    """

    def __init__(self, threshold: int):
        words = np.arange(1 << LENGTH, dtype=np.int64)
        weight = np.bitwise_count(words)
        near = words[weight <= RADIUS + threshold]
        weight = weight[near].astype(np.int64)
        of = syndromes(near)
        order = np.lexsort((near, weight, of))
        self.differences = near[order]
        self.over = np.maximum(weight[order] - RADIUS, 0)
        self.bounds = np.searchsorted(of[order], np.arange((1 << CHECKS) + 1))

    def around(self, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the word, codeword, bits over) of all codewords at most ``most`` bits over the radius."""
        s = syndromes(words)
        size = self.bounds[s + 1] - self.bounds[s]
        place = np.repeat(np.arange(len(words)), size)
        at = np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bounds[s], size)
        keep = self.over[at] <= most
        place, at = place[keep], at[keep]
        return place, words[place] ^ self.differences[at], self.over[at]


def anchors(words: np.ndarray, balls: GolayBalls, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the fingerprint, anchor, home) of all replicas of 64-bit fingerprints."""
    low, high = (words & ((1 << LENGTH) - 1)).astype(np.int64), (words >> np.uint64(LENGTH) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    first, code, over = balls.around(low, threshold)
    second, other, more = balls.around(high, threshold)
    # the pairs of the codewords of both blocks that together stay within the threshold
    n_second = np.bincount(second, minlength=len(words))
    starts = np.cumsum(n_second) - n_second
    size = n_second[first]
    left = np.repeat(np.arange(len(first)), size)
    right = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[first], size)
    keep = over[left] + more[right] <= threshold
    left, right = left[keep], right[keep]
    # within the radius there is one codeword for each block: the home
    return first[left], code[left] << LENGTH | other[right], (over[left] == 0) & (more[right] == 0)


def replicas(distinct: DataFrame, threshold: int) -> DataFrame:
    """(f, anchor, home) of every fingerprint at every anchor within radius and threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = process_wide(f"golay balls {threshold}", lambda: GolayBalls(threshold))
        for batch in batches:
            found = batch.column("f").to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(found), _BLOCK):
                f = found[s:s + _BLOCK]
                place, anchor, home = anchors(f, balls, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(f[place].view(np.int64)), pa.array(anchor), pa.array(home)], names=["f", "anchor", "home"])

    return distinct.mapInArrow(work, "f long, anchor long, home boolean")


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(distinct: DataFrame, threshold: int = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """(a, b) pairs of distinct fingerprints with at most ``threshold`` differing bits: all of them between members of
    ordinary anchors, and between members of crowded ones as many as connect the same classes."""
    if not 0 <= threshold <= 2:
        raise ValueError("threshold must be 0, 1 or 2")
    placed = written(replicas(distinct, threshold), "replicas")
    at_home = placed.filter("home").select("anchor", F.col("f").alias("a"))
    # an anchor is crowded by what is at home there; the few that are, are known by their number alone
    packed = written(at_home.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > crowded), "crowded")
    some = not packed.isEmpty()
    ordinary, home = placed, at_home
    if some:
        home = at_home.join(packed, "anchor", "left_anti")
    met = home.join(ordinary.select("anchor", F.col("f").alias("b")), "anchor")
    near = met.filter((F.col("a") != F.col("b")) & (differing(F.col("a"), F.col("b")) <= threshold)).select("a", "b")
    if not some:
        return near
    members = placed.join(packed, "anchor", "left_semi").select("f").distinct()
    return near.unionByName(_through_neighbours(members, threshold))


def _through_neighbours(members: DataFrame, threshold: int) -> DataFrame:
    """Links that connect all members at most ``threshold`` bits apart, by the words within one bit of
    two of them. No group has more than 65 members, and one member of each is linked to the others."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("f").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    around = members.select("f", F.explode(F.concat(F.array("f"), flips)).alias("word"))
    groups = around.groupBy("word").agg(F.collect_set("f").alias("fs")).filter(F.size("fs") > 1)
    if threshold < 2:  # one of the two is the word itself
        groups = groups.filter(F.array_contains("fs", F.col("word")))
        pairs = groups.select(F.col("word").alias("a"), F.explode("fs").alias("b"))
    else:
        pairs = groups.select(F.array_min("fs").alias("a"), F.explode("fs").alias("b"))
    return pairs.filter((F.col("a") != F.col("b")) & (differing(F.col("a"), F.col("b")) <= threshold))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("f").agg(F.min("id").alias("least")), "distinct-fingerprints")
    found = written(links(distinct.select("f"), threshold, crowded).distinct(), "links")
    rooted = components(found)  # of linked fingerprints only; others are alone
    classes = distinct.join(rooted, distinct["f"] == rooted["node"]).select("f", "root", "least")
    named = classes.join(classes.groupBy("root").agg(F.min("least").alias("name")), "root").select("f", "name")
    named = distinct.join(named, "f", "left").select("f", F.coalesce("name", "least").alias("component_id"))
    return rows.join(written(named, "classes"), "f").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
