"""Removal of byte strings that an earlier document holds, by suffix sorting.

A byte of a document goes if it is covered by a string of ``length`` bytes (50) that also starts in a
document with a smaller id. To find these, the suffixes of the texts are sorted by the difference-cover
algorithm and neighbours in that order are compared over their first ``length`` bytes.

The sort is spread over tasks by content. Of the short grams inside a window of ``length`` bytes the one
with the least hash is its minimiser; equal windows have the same minimiser at the same place. So

1. grams that are minimisers in two documents at least are found by one shuffle of (gram, id);
2. for those grams the pieces of text whose windows they rule are sent to the task of the gram, with
   equal pieces of equal documents sent once; everything else can't repeat and stays where it is;
3. each task joins its pieces and sorts their suffixes: triples at two thirds of the places (a difference
   cover) are sorted and named, the names are sorted by recursion, the other suffixes are merged in;
4. runs of suffixes whose neighbours agree on ``length`` bytes are one string, with the least id of its
   documents: windows of larger ids are marked, and marks are merged for each document.

Matches never cross documents, since windows lie inside one text, which is compared as UTF-8. Null
counts as empty. Texts shorter than ``length`` lose nothing. Repeated rows (same id) don't remove each
other. A null id is neither smaller nor larger than others, so such rows lose nothing. A frequent gram
counts once for each document, so no task gets more than a small share of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pharmatext.llm.storage import release, small_batches, tasks, written
from pharmatext.llm.words import _powers, chunks, mix

LENGTH, GRAM = 50, 20
GROUP_BYTES = 1 << 21
HOT_DOCUMENTS = 1 << 15  # documents that share a gram, from which its windows are dealt out one by one; places inside a document are not counted


# ---- minimisers ----

def windows(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last, gram hash) of each run of windows with one minimiser; places count in the text."""
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    none = np.empty(0, dtype=np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64)
    powers, inverses = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    hashes = mix((sums[gram:] - sums[:-gram]) * inverses[: n - gram + 1])
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have < width:  # least of the next ``have`` grams, doubled until the window is full
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    valid = np.ones(len(least), dtype=bool)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        valid[max(start, end - length + 1) : end] = False  # windows that would leave the text
    place = least.astype(np.uint32)
    same = valid[1:] & valid[:-1] & (place[1:] == place[:-1])
    first, last = valid.copy(), valid.copy()
    first[1:] &= ~same
    last[:-1] &= ~same
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    owner = np.searchsorted(bounds, first, side="right") - 1
    # 48 bits name a gram well enough: two grams of one name only make their pieces meet
    return owner, first - bounds[owner], last - bounds[owner], hashes[place[first]] >> np.uint64(16)


# ---- difference-cover suffix sort ----

def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of the keys, their dense ranks from 1, and how many differ."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    names = np.empty(len(keys), dtype=np.int64)
    names[order] = np.cumsum(new)
    return order, names, int(new.sum())


def suffix_order(text: np.ndarray, enough: int | None = None, unit: int = 1) -> np.ndarray:
    """Start places of all suffixes of an array of positive integers, in order of the suffixes.

    With ``enough`` only that many first places decide; names of triples that span them (each place
    being ``unit`` of the original ones) need no further recursion."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), dtype=np.int64)
    base = int(text.max()) + 1
    t = np.zeros(n + 3, dtype=np.int64)
    t[:n] = text
    pair = t[:-1] * base + t[1:]
    if base * base * max(base, n + 1) >= 1 << 63:  # a pair and a place or rank must fit 63 bits
        pair = _ranks(pair)[1]
    places = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])  # the cover: 1 and 2 modulo 3
    triples = pair[places] * base + t[places + 2]
    order, names, different = _ranks(triples)
    if different < len(places) and (enough is None or 3 * unit < enough + 2):
        order = suffix_order(names, enough, 3 * unit)
        names = np.empty(len(places), dtype=np.int64)
        names[order] = np.arange(1, len(places) + 1)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[places] = names
    sampled = places[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    top = int(rank.max()) + 1
    rest = rest[np.argsort(t[rest] * top + rank[rest + 1], kind="stable")]
    # how many sampled suffixes stand before each of the others: those at 1 modulo 3 compare by a place and a
    # rank, those at 2 by two places and a rank, as both sides then are sampled
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before_one = np.searchsorted(np.sort(t[one] * top + rank[one + 1]), t[rest] * top + rank[rest + 1])
    before_two = np.searchsorted(np.sort(pair[two] * top + rank[two + 2]), pair[rest] * top + rank[rest + 2])
    low = before_one + before_two
    out = np.empty(n, dtype=np.int64)
    # among suffixes that agree on ``enough`` places any order will do, but places must ascend
    at = np.maximum.accumulate(low) + np.arange(len(rest))
    out[at] = rest
    others = np.ones(n, dtype=bool)
    others[at] = False
    out[others] = sampled
    return out


def earliest(pieces: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For every window of each piece the least id of the pieces that hold the same string."""
    distinct: dict[bytes, int] = {}
    number = np.array([distinct.setdefault(p, len(distinct)) for p in pieces])
    least = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    unique = list(distinct)
    sizes = np.array([len(p) for p in unique])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(unique) + b"\0" * 8, dtype=np.uint8)
    owner = np.repeat(np.arange(len(unique)), sizes)
    opens = np.arange(bounds[-1]) + length <= bounds[owner + 1]
    order = suffix_order(data[: bounds[-1]].astype(np.int64) + 1, length)
    order = order[opens[order]]  # suffixes that start a window
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    eight = np.ascontiguousarray(words).view(np.uint64).ravel()
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), dtype=bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        same &= eight[a + k] == eight[b + k]
    group = np.concatenate([[0], np.cumsum(~same)])
    of_group = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(of_group, group, least[owner[order]])
    found = np.empty(len(data), dtype=np.int64)
    found[order] = of_group[group]
    by_piece = [found[bounds[i] : bounds[i + 1] - length + 1] for i in range(len(unique))]
    return [by_piece[k] for k in number]


# ---- the job ----

def _repeated_grams(rows: DataFrame) -> DataFrame:
    """(id, gram) for all minimisers that at least two documents have."""
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for a, b in chunks(texts):
                text, _, _, gram = windows(texts[a:b])
                order = np.lexsort((gram, text))
                text, gram = text[order], gram[order]
                new = np.ones(len(gram), dtype=bool)
                new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(gram[new].view(np.int64)), pa.array(ids[a:b][text[new]].astype(np.int64))], names=["gram", "id"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of the gram; one that stands alone is dropped."""
        last: tuple[int, int, bool] | None = None  # the last row, and whether it has been passed on
        for batch in batches:
            gram, key = batch.column("gram").to_numpy(), batch.column("id").to_numpy()
            if not len(gram):
                continue
            meets = np.zeros(len(gram), dtype=bool)
            pair = (gram[1:] == gram[:-1]) & (key[1:] != key[:-1])
            meets[1:] |= pair
            meets[:-1] |= pair
            out_gram, out_key = [], []
            if last is not None and last[0] == gram[0] and last[1] != key[0]:
                meets[0] = True
                if not last[2]:
                    out_gram, out_key = [last[0]], [last[1]]
            last = (int(gram[-1]), int(key[-1]), bool(meets[-1]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(np.array(out_key, dtype=np.int64), key[meets])), pa.array(np.append(np.array(out_gram, dtype=np.int64), gram[meets])),
            ], names=["id", "gram"])

    n = tasks(rows.sparkSession)
    met = rows.filter("id IS NOT NULL").mapInArrow(take, "gram long, id long")
    return met.repartition(n, "gram").sortWithinPartitions("gram", "id").mapInArrow(shared, "id long, gram long")


def _gram_lists(rows: DataFrame) -> DataFrame:
    """(id, grams): the repeated minimisers of each document, a list bounded by its text."""
    lists = written(_repeated_grams(rows).groupBy("id").agg(F.collect_list("gram").alias("grams")), "grams")
    release(rows.sparkSession)
    return lists


def _pieces(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """(gram, id, row, start, piece): the text under the windows of repeated grams."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            wanted = [w.values.to_numpy() for w in batch.column("grams")]
            ids, marks = batch.column("id").to_pylist(), batch.column("row").to_pylist()
            for a, b in chunks(texts):
                text, first, last, gram = windows(texts[a:b])
                gram = gram.view(np.int64)
                ends = np.searchsorted(text, np.arange(b - a + 1))
                out: list[tuple] = []
                for i in range(b - a):
                    part = slice(ends[i], ends[i + 1])
                    hit = np.isin(gram[part], wanted[a + i])
                    raw, key, mark = texts[a + i], ids[a + i], marks[a + i]
                    out += [(g, key, mark, f, raw[f : l + LENGTH]) for g, f, l in zip(gram[part][hit].tolist(), first[part][hit].tolist(), last[part][hit].tolist(), strict=True)]
                if out:
                    g, k, m, f, p = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(k, pa.int64()), pa.array(m, pa.int64()), pa.array(f, pa.int64()), pa.array(p, pa.binary())], names=["gram", "id", "row", "start", "piece"])

    return rows.join(lists, "id").select("id", "row", "text", "grams").mapInArrow(cut, "gram long, id long, row long, start long, piece binary")


def _marks(pieces: DataFrame) -> DataFrame:
    """(id, row, spans): runs of window starts to mark, as pairs of first and last start."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def work(rows: pa.Table) -> pa.RecordBatch:
            gram, key, row, start = (rows.column(c).to_numpy() for c in ("gram", "id", "row", "start"))
            pieces_ = rows.column("piece").to_pylist()
            seen: dict[bytes, int] = {}
            number = np.array([seen.setdefault(p, len(seen)) for p in pieces_])
            sizes = np.array([len(p) for p in pieces_])
            opens = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            group = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(gram))))
            # pieces of a gram that are all equal need no sorting
            alike = (np.maximum.reduceat(number, opens) == np.minimum.reduceat(number, opens))[group]
            gone = alike & (np.minimum.reduceat(key, opens)[group] < key)
            out = [np.stack([key[gone], row[gone], start[gone], start[gone] + sizes[gone] - LENGTH])]
            others = np.flatnonzero(~alike)
            if len(others):
                found = []
                for i, least in zip(others.tolist(), earliest([pieces_[i] for i in others.tolist()], key[others]), strict=True):
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], (least < key[i]).view(np.int8), [0]])))
                    found += [(key[i], row[i], start[i] + x, start[i] + y - 1) for x, y in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
                out.append(np.array(found, dtype=np.int64).reshape(-1, 4).T)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(out, axis=1)], names=["id", "row", "first", "last"])

        for batch in batches:
            if size >= GROUP_BYTES:  # up to where the last gram of what is held ends
                last, gram = held[-1].column("gram")[-1].as_py(), batch.column("gram").to_numpy()
                end = int(np.searchsorted(gram, last, side="right"))
                held.append(batch.slice(0, end))
                batch = batch.slice(end)
                if not batch.num_rows:
                    continue
                yield work(pa.Table.from_batches(held))
                held, size = [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.column("piece").nbytes
        if held:
            yield work(pa.Table.from_batches(held))

    n = tasks(pieces.sparkSession)
    laid = pieces.repartition(n, "gram").sortWithinPartitions("gram")
    return laid.mapInArrow(sort, "id long, row long, first long, last long")


def _hot_marks(pieces: DataFrame) -> DataFrame:
    """The same marks for grams of many documents: windows meet by their digest, so no task gets a gram whole."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row, start = (batch.column(c).to_numpy() for c in ("id", "row", "start"))
            found = batch.column("piece").to_pylist()
            counts = np.array([len(p) - LENGTH + 1 for p in found], dtype=np.int64)
            digests = [blake2b(p[i : i + LENGTH], digest_size=16).digest() for p in found for i in range(len(p) - LENGTH + 1)]
            at = np.repeat(start, counts) + np.arange(len(digests)) - np.repeat(np.cumsum(counts) - counts, counts)
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(key, counts), np.repeat(row, counts), at, halves[:, 0].copy(), halves[:, 1].copy())], names=["id", "row", "first", "high", "low"])

    held = written(pieces.mapInArrow(cut, "id long, row long, first long, high long, low long"), "hot-windows")
    least = held.groupBy("high", "low").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    return held.join(least, ["high", "low"]).filter("id > least").select("id", "row", "first", F.col("first").alias("last"))


def _all_marks(rows: DataFrame, lists: DataFrame) -> DataFrame:
    one = lists.select("id", F.explode("grams").alias("gram"))
    hot = written(one.groupBy("gram").count().filter(F.col("count") > HOT_DOCUMENTS).select("gram"), "hot-grams")
    if hot.isEmpty():
        return _marks(_pieces(rows, lists))
    kinds = [written(one.join(hot, "gram", how).groupBy("id").agg(F.collect_list("gram").alias("grams")), "grams") for how in ("left_anti", "left_semi")]
    return _marks(_pieces(rows, kinds[0])).unionByName(_hot_marks(_pieces(rows, kinds[1])))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, on request with the bytes that stay."""
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            rows = []
            for raw, spans in zip(raws, batch.column("spans").to_pylist(), strict=True):
                kept, at, removed, count = [], 0, 0, 0
                end = -1
                for s in sorted((s["first"], s["last"] + LENGTH) for s in spans or []):
                    if s[0] > end:  # a gap: the run before has ended
                        count += 1
                        kept.append(raw[at : s[0]])
                        removed += s[1] - s[0]
                        at = end = s[1]
                    elif s[1] > end:
                        removed += s[1] - end
                        at = end = s[1]
                rest = b"".join(kept) + raw[at:]
                rows.append((len(raw), removed, count, sha256(rest).hexdigest(), rest))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [batch.column("id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(columns[4], pa.binary())] if with_text else []), names=names + ["kept"] * with_text)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # rows of one id are told apart by their text; where no id repeats there is nothing to tell apart
    repeated = not rows.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").isEmpty()
    row = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(0xFFFFFFFF) if repeated else F.lit(0).cast("long")
    marked = rows.withColumn("row", row)
    marks = _all_marks(marked.filter("id IS NOT NULL"), _gram_lists(rows))
    spans = written(marks.groupBy(F.col("id").alias("m_id"), F.col("row").alias("m_row")).agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    del marks
    release(docs.sparkSession)
    met = marked.join(spans, (F.col("id") == F.col("m_id")) & (F.col("row") == F.col("m_row")), "left").select("id", "text", "spans")
    return met.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
