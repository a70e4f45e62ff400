"""Near-duplicate classes: consistent weighted sampling of TF-IDF shingles, banded and verified.

A text is the multiset of its five-word shingles. The weight of a shingle is its count times
``1 + ln((1 + N) / (1 + df)) / ln(1 + N)``, between 1 and 2 times its count. Document frequencies of
all documents are kept in a table of 2^20 hashed counters, so what is broadcast has a fixed size.

Improved consistent weighted sampling draws ``bands * rows`` samples of each text; two texts agree on
a sample with the probability of their weighted Jaccard similarity. Texts that agree on all samples of
a band meet in a bucket. Within a bucket all members are compared with one hub, the most typical
member. Who is not in the bucket's largest class then is compared with every member of another class
that it can be like at all: what both share with the hub, and what no other text shares with them,
bounds their similarity, so members of a large group that are merely similar form no pairs, and no
link inside a bucket is lost. A pair counts if the weighted Jaccard similarity of the whole texts is
at least ``threshold``. Classes are the connected components of these links.

Texts with the same shingles in the same order are one text from the start, so copies cost nothing.
Texts without any word are alike only if identical; null counts as empty. Texts of one to four words
have one shingle. Repeated rows are in one class; an empty table gives no rows. Ids that are null stay
null, and the class id is the least id that isn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from pharmatext.llm.components import components
from pharmatext.llm.counting import summed
from pharmatext.llm.storage import fresh, scratch, small_batches, written
from pharmatext.llm.words import chunks, mix, shingle_hashes, word_hashes

THRESHOLD, BANDS, ROWS = 0.8, 16, 5
COUNTERS = 1 << 20
_TABLE_BITS = 17


def text_digest(shingles: np.ndarray, text: str) -> bytes:
    return blake2b(shingles.tobytes() if len(shingles) else b"!" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)  # the top 20 bits


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their counts, and the bounds by text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(h)))
    return h[first], counts, np.searchsorted(t[first], np.arange(len(bounds)))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a shingle of each hashed counter, over all rows, and the number of rows."""

    def tally(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        seen = None
        for batch in batches:
            seen = np.zeros(COUNTERS + 1, dtype=np.int64) if seen is None else seen
            column = batch.column(0).to_pylist()
            seen[COUNTERS] += len(column)
            for a, b in chunks(column):
                h, _, _ = _distinct(*shingle_hashes(*word_hashes(column[a:b])))
                np.add.at(seen, _counters(h), 1)
        return seen

    out = summed(texts, tally, COUNTERS + 1)
    return out[:COUNTERS], int(out[COUNTERS])


def idf_table(df: np.ndarray, n: int) -> np.ndarray:
    return (1.0 + np.log((1.0 + n) / (1.0 + df)) / np.log(1.0 + max(n, 1))).astype(np.float32)


class Sampler:
    """Draws consistent weighted samples. The random numbers of (shingle, sample) come from tables of
    Gamma(2, 1) and uniform variates at a place that is a hash of both."""

    def __init__(self, samples: int, seed: int = 11):
        random = np.random.default_rng(seed)
        n = 1 << _TABLE_BITS
        self.r = random.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(random.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = random.random(n).astype(np.float32)
        self.keys = random.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """An identifier of each sample of each text (rows); texts without shingles get 0."""
        filled = np.flatnonzero(np.diff(bounds))
        out = np.zeros((len(bounds) - 1, len(self.keys)), dtype=np.uint32)
        if not len(filled):
            return out
        starts, log_w, low = bounds[filled], np.log(weights).astype(np.float32), mix(hashes).astype(np.uint32)
        for k, key in enumerate(self.keys):
            at = ((hashes * key) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
            r, beta = self.r[at], self.beta[at]
            t = np.floor(log_w / r + beta)
            log_a = self.log_c[at] - r * (t - beta + np.float32(1))
            bits = log_a.view(np.uint32)
            bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000))  # sorts as the number does
            identity = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
            out[filled, k] = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | identity, starts).astype(np.uint32)
        return out


def signatures(rows: DataFrame, idf: Broadcast, bands: int, per_band: int) -> DataFrame:
    """(id, node, rarity, bands): the text's digest, how rare its shingles are, its bucket keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, table = Sampler(bands * per_band), idf.value
        factors = mix(np.arange(1, per_band + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts):
                h, bounds = shingle_hashes(*word_hashes(texts[a:b]))
                nodes = [text_digest(h[bounds[i] : bounds[i + 1]], texts[a + i]) for i in range(b - a)]
                d, counts, ends = _distinct(h, bounds)
                rarity = table[_counters(d)]
                drawn = sampler.draw(d, rarity * counts, ends).astype(np.uint64).reshape(b - a, bands, per_band)
                keys = mix((drawn * factors).sum(axis=2, dtype=np.uint64) ^ np.arange(bands, dtype=np.uint64)).view(np.int64)
                sums = np.concatenate([[0.0], np.cumsum(rarity, dtype=np.float64)])
                n = np.maximum(np.diff(ends), 1)
                rarity_mean = (sums[ends[1:]] - sums[ends[:-1]]) / n
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a), pa.array(nodes, pa.binary()), pa.array(rarity_mean, pa.float64()),
                    pa.array([k.tolist() if e else None for k, e in zip(keys, np.diff(ends), strict=True)], pa.list_(pa.int64())),
                ], names=["id", "node", "rarity", "bands"])

    return rows.mapInArrow(work, "id long, node binary, rarity double, bands array<long>")


def _weigh(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingles of a text and their weights."""
    h, counts = np.unique(shingle_hashes(*word_hashes([text]))[0], return_counts=True)
    return h, table[_counters(h)].astype(np.float64) * counts


def measured(pairs: DataFrame, texts: DataFrame, idf: Broadcast) -> DataFrame:
    """Pairs (hub, node) with the weights of both whole texts and of what they share."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hub, known = idf.value, None, None
        for batch in batches:
            shared, own, hubs = [], [], []
            for h, a, b in zip(batch.column("hub").to_pylist(), batch.column("hub_text").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if h != hub:
                    hub, known = h, _weigh(a, table)
                other = _weigh(b, table)
                _, i, j = np.intersect1d(known[0], other[0], assume_unique=True, return_indices=True)
                shared.append(float(np.minimum(known[1][i], other[1][j]).sum()))
                own.append(float(other[1].sum()))
                hubs.append(float(known[1].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("node"), *[pa.array(x, pa.float64()) for x in (shared, own, hubs)]], names=["hub", "node", "shared", "w", "w_hub"])

    met = pairs.join(texts, "node").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
    return met.select("hub", "hub_text", "node", "text").mapInArrow(work, "hub binary, node binary, shared double, w double, w_hub double")


def _likeness(shared: Column, w1: Column, w2: Column) -> Column:
    return shared / (w1 + w2 - shared)


def own_weights(texts: DataFrame, idf: Broadcast, part: float) -> DataFrame:
    """(node, own): the weight of shingles that none of the other texts holds anywhere, at least of those
    among the rarest ones that make up ``part`` of the text's weight. Every shingle of a text counts as
    held; only the rarest bring along their text, as two halves of its digest, and their weight."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h, w = _weigh(text, idf.value)
                order = np.argsort(-idf.value[_counters(h)], kind="stable")
                n = int(np.searchsorted(np.cumsum(w[order]), part * w.sum())) + 1
                high, low = np.frombuffer(node, dtype=">i8").astype(np.int64)
                parts.append((h[order].view(np.int64), np.full(len(h), high), np.full(len(h), low), w[order], np.arange(len(h)) >= n))
            if parts:
                token, high, low, weight, common = (np.concatenate(c) for c in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(token), *[pa.array(c, mask=common) for c in (high, low, weight)]], names=["token", "high", "low", "weight"])

    # columns of fixed size, so that grouping needs no sort
    tokens = texts.mapInArrow(held, "token long, high long, low long, weight double")
    alone = tokens.groupBy("token").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ("high", "low", "weight")]).filter("n = 1 AND weight IS NOT NULL")
    node = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("high", "low")]))
    return alone.groupBy("high", "low").agg(F.sum("weight").alias("own")).select(node.alias("node"), "own")


def links(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], idf: Broadcast, threshold: float) -> DataFrame:
    """(a, b): enough links to make up every class of the nodes (node, rarity, bands)."""
    placed = nodes.filter("bands IS NOT NULL").select("node", "rarity", F.explode("bands").alias("bucket"))
    # the hub of a bucket is its most typical member: a minimum, so each task sends one row for a bucket
    hubs = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("rarity", "node"))["node"].alias("hub")).filter("n > 1")
    members = written(placed.join(hubs, "bucket").select("bucket", "node", "hub"), "near-members")
    texts = written(texts_of(members.select("node").distinct()), "near-texts")
    first = written(measured(members.filter("node != hub").select("hub", "node").distinct(), texts, idf), "near-first")
    found = first.filter(_likeness(F.col("shared"), F.col("w"), F.col("w_hub")) >= threshold).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    root_of = components(found)
    # Members outside their bucket's largest class are compared with all others of the bucket that they can be
    # like at all. Of two members that share s1 and s2 with the hub, and have o1 and o2 that no other text of
    # such buckets holds, the common weight is at most min(s1, s2) + min(w1 - s1 - o1, w2 - s2 - o2).
    classed = members.filter("node != hub").join(root_of, "node", "left").join(first, ["hub", "node"])
    classed = written(classed.select("bucket", "hub", "node", F.coalesce("root", "node").alias("root"), "shared", "w"), "near-classed")
    per_class = classed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = per_class.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("classes")).filter("classes > 1")
    mixed = classed.join(main, "bucket")
    # hubs are among the texts: what a text shares with its hub is not its own
    unsettled = mixed.select("node").unionByName(mixed.select(F.col("hub").alias("node"))).distinct()
    own = own_weights(texts.join(unsettled, "node", "left_semi"), idf, 1.1 - threshold)
    rest = F.greatest(F.lit(0.0), F.col("w") - F.col("shared") - F.coalesce("own", F.lit(0.0)))
    classed = written(mixed.join(own, "node", "left").select("bucket", "node", "root", "main", "shared", "w", rest.alias("rest")), "near-mixed")
    free = classed.filter("root != main").select("bucket", *[F.col(c).alias(f"f_{c}") for c in ("node", "root", "shared", "w", "rest")])
    most = F.least("shared", "f_shared") + F.least("rest", "f_rest")
    near = (F.col("root") != F.col("f_root")) & (_likeness(most, F.col("w"), F.col("f_w")) >= threshold - 1e-9)
    pairs = classed.join(free, (classed["bucket"] == free["bucket"]) & near).select(F.least("node", "f_node").alias("hub"), F.greatest("node", "f_node").alias("node")).distinct()
    second = measured(pairs, texts, idf).filter(_likeness(F.col("shared"), F.col("w"), F.col("w_hub")) >= threshold)
    return found.unionByName(second.select(F.col("hub").alias("a"), F.col("node").alias("b")))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, kept) of every row; the least id of a class is its id and stays."""
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    df, n = document_frequencies(narrow.select("text"))
    idf = spark.sparkContext.broadcast(idf_table(df, n))
    signed = written(signatures(narrow, idf, bands, rows), "near-signatures")
    nodes = written(signed.groupBy("node").agg(F.min("id").alias("id"), F.min("rarity").alias("rarity"), F.any_value("bands").alias("bands"), F.count("*").alias("n")), "near-nodes")
    owners = nodes.select(F.col("id").alias("owner"), "node")
    root_of = components(links(nodes.select("node", "rarity", "bands"), lambda wanted: _texts_of(narrow, owners.join(wanted, "node")), idf, threshold))
    classed = nodes.join(root_of, "node", "left").select("node", "id", "n", F.coalesce("root", "node").alias("root"))
    classes = classed.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    of_node = classed.join(classes, "root").select("node", "class_id", "class_size")
    out = signed.select("id", "node").join(of_node, "node")
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), "node")


def _texts_of(narrow: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, text): the text of each (owner, node), found by its id; digests tell rows of one id apart."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            made = []
            for a, b in chunks(texts):
                h, bounds = shingle_hashes(*word_hashes(texts[a:b]))
                made += [text_digest(h[bounds[i] : bounds[i + 1]], texts[a + i]) for i in range(b - a)]
            same = pa.array([x == y for x, y in zip(made, batch.column("node").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(same), batch.column("text").filter(same)], names=["node", "text"])

    met = narrow.join(owners, narrow["id"].eqNullSafe(owners["owner"])).select("node", "text")
    return met.mapInArrow(work, "node binary, text string").dropDuplicates(["node"])


def kept_rows(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that with the least id, with the columns of ``docs``; of repeated rows one.

    Rows of one id with different texts are told apart by their shingles; columns of any name are passed on.
    """
    key, node, n = (fresh(docs, name) for name in ("_near_id", "_near_node", "_near_n"))
    with scratch(docs.sparkSession):
        classes = near_classes(docs, threshold, id_col=id_col, text_col=text_col)
        ids = classes.groupBy(F.col("doc_id").alias(key)).agg(F.max("kept").alias("kept"), F.count("*").alias(n))
        ids = written(ids.filter("kept").select(key, n), "near-kept", lasting=True)
        repeated = ids.filter(F.col(n) > 1)
        alone = repeated.isEmpty()
        if not alone:
            nodes = classes.filter("kept").select(F.col("doc_id").alias(key), F.col("node").alias(node)).distinct()
            met = nodes[key].eqNullSafe(repeated[key])
            nodes = written(nodes.join(repeated, met, "left_semi"), "near-kept-texts", lasting=True)
    same_id = F.col(id_col).cast("long").eqNullSafe(F.col(key))
    stays = docs.join(ids, same_id, "left_semi")
    if alone:
        return stays
    many = _with_node(stays.join(repeated, same_id, "left_semi"), text_col, node)
    # the node's name stands on both sides, so the table of nodes is joined under another
    wanted = nodes.withColumnRenamed(node, f"{node}_kept")
    many = many.join(wanted, same_id & (F.col(node) == F.col(f"{node}_kept")), "left_semi").dropDuplicates([id_col, node])
    return stays.join(repeated, same_id, "left_anti").unionByName(many.drop(node))


def _with_node(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """``rows`` with the digest that ``near_classes`` knows each text by."""

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        whole, made = [t or "" for t in texts.to_pylist()], []
        for a, b in chunks(whole):
            h, bounds = shingle_hashes(*word_hashes(whole[a:b]))
            made += [text_digest(h[bounds[i] : bounds[i + 1]], whole[a + i]) for i in range(b - a)]
        return pa.array(made, pa.binary())

    return rows.withColumn(name, digest(F.col(text_col)))
