"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words that no piece crosses. The distinct words of all texts are encoded as a join:
their substrings up to the longest piece are exploded and equi-joined with the piece table, the edges
found are grouped by word, and a fold (Spark's higher-order ``aggregate``) picks the path:

- files of type unigram: the Viterbi path of the highest sum of scores, unknown characters at a penalty;
- files of type BPE: starting from single characters, the best-scored edge (the leftmost of equals) that
  joins two neighbouring symbols is applied until none is left. A sum of the scores of such a file
  does not give the library's ids; this fold over the same lattice does.

Characters without a piece become byte pieces (or the unknown piece where the file has none). Words of
more than ``LATTICE_CHARS`` characters, whose lattice would be long, are encoded by the library.

Words come to the texts in two tiers. The most frequent words (at most ``FREQUENT``, about 30 MB) are
encoded once and broadcast as arrays. Most other words stand in one text only, so to collect them and bring them
back would cost more than it saves: the task of a text builds their lattice itself, as arrays over all words
of a chunk (``lattice``). Neither texts nor rare words are shuffled. Null and empty texts have no ids;
repeated rows get the same ids. White space other than blanks is kept, so decoding gives the
text back, but for the sign that the library itself uses for a blank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pharmatext.llm.lattice import Lattice, runs
from pharmatext.llm.storage import discard, release, setting, small_batches, tasks, written
from pharmatext.llm.words import _hash, _powers, chunks, process_wide

BLANK = "▁"
LATTICE_CHARS = 62
FREQUENT = 1 << 20
#: Frequencies below this are told apart when the table of frequent words is cut, higher ones by powers of two.
COUNTED_APART = 10_000
#: Words are dealt to so many parts for each task, so that the edges of one part are grouped in memory.
PARTS_PER_TASK, GROUPED_IN_MEMORY = 8, 1 << 16
UNIGRAM, BPE = 1, 2
#: An edge in 64 bits: rank of its score, start, end, id. So edges sort as (score, start, end).
ID_BITS, END_BITS, START_BITS = 21, 7, 6
#: Texts are cut into words by about so many characters at a time: a worker keeps the most that its work arrays once took.
CUT_CHARS = 1 << 17
PLACES = ((1 << START_BITS + END_BITS) - 1) << ID_BITS


@dataclass(frozen=True)
class PieceTable:
    """What a model file says: pieces with blanks as blanks, scores, byte pieces, kind."""

    path: str
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    bytes_from: int | None
    unknown: int
    kind: int

    @staticmethod
    def read(path: str) -> PieceTable:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rule = model.normalizer_spec
        if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not rule.escape_whitespaces:
            raise ValueError("only files that leave characters and white space as they are")
        kinds = [p.type for p in model.pieces]  # 1 normal, 2 unknown, 6 byte
        pieces = tuple(p.piece.replace(BLANK, " ") for p in model.pieces)
        if any(k == 4 for k in kinds) or any(p.strip(" ") and " " in p[1:] or "\n" in p or "\t" in p for p, k in zip(pieces, kinds, strict=True) if k == 1):
            raise ValueError("a piece crosses words")
        return PieceTable(path, pieces, tuple(p.score for p in model.pieces), tuple(k == 1 for k in kinds), kinds.index(6) if 6 in kinds else None, kinds.index(2), model.trainer_spec.model_type)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score, rank): the best score has rank 0, equal scores have one rank. An empty piece comes with them."""
        if len(self.pieces) >= 1 << ID_BITS:
            raise ValueError("too many pieces")
        ranks = {s: i for i, s in enumerate(sorted(set(self.scores), reverse=True))}
        rows = [(p, i, float(s), ranks[s]) for i, (p, s, n) in enumerate(zip(self.pieces, self.scores, self.normal, strict=True)) if n]
        return spark.createDataFrame([*rows, ("", 0, 0.0, len(ranks))], "piece string, id int, score double, rank long")


# ---- words ----

def _blanked(texts: list[str | None]) -> list[str]:
    """Texts as the library sees them, with blanks for its blank sign: one blank more in front."""
    return [" " + t.replace(BLANK, " ") if t else "" for t in texts]


def words_in(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes, bounds by text) of the words: blanks and what follows them, or a line break or tab."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    n = len(data)
    if not n:
        none = np.empty(0, dtype=np.int64)
        return data, none, none, none.astype(np.uint64), np.zeros(len(parts) + 1, dtype=np.int64)
    blank, control = data == 32, (data == 10) | (data == 9)
    opens = control.copy()
    opens[1:] |= control[:-1] | (blank[1:] & ~blank[:-1])
    opens[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], n)
    powers, inverses = _powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return data, starts, ends, _hash(starts, ends, sums, inverses), np.searchsorted(starts, bounds)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all words of a table of one text column; each batch sends its distinct words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = _blanked(batch.column(0).to_pylist())
            total: dict[bytes, int] = {}
            for a, b in chunks(column, CUT_CHARS):
                data, starts, ends, hashes, _ = words_in(column[a:b])
                raw = data.tobytes()
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                for s, e, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                    word = raw[s:e]
                    total[word] = total.get(word, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- the lattice ----

def _start(edge: Column) -> Column:
    return F.shiftright(edge, ID_BITS + END_BITS).bitwiseAND((1 << START_BITS) - 1).cast("int")


def _end(edge: Column) -> Column:
    return F.shiftright(edge, ID_BITS).bitwiseAND((1 << END_BITS) - 1).cast("int")


def _id(edge: Column) -> Column:
    return edge.bitwiseAND((1 << ID_BITS) - 1).cast("int")


def edges(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, n, edges): for each word its substrings that are pieces, as numbers that hold rank, places and id.

    Words are dealt out once; their substrings stay in that task until they are edges of the word. An
    empty substring matches an entry of its own, so words without any piece stay too.
    """
    longest = max(len(p) for p, n in zip(table.pieces, table.normal, strict=True) if n)
    dealt, n = words.select("word", "n").repartition(PARTS_PER_TASK * tasks(words.sparkSession), "word"), F.length("word")
    starts = dealt.select("word", "n", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("word", "n", "s", F.explode(F.sequence(F.when(F.col("s") == 0, 0).otherwise(1), F.least(n - F.col("s"), F.lit(longest)))).alias("l"))
    pieces = table.frame(words.sparkSession).select("piece", F.shiftleft("rank", START_BITS + END_BITS + ID_BITS).bitwiseOR(F.col("id").cast("long")).alias("top"))
    met = spans.withColumn("piece", F.substr("word", F.col("s") + 1, F.col("l"))).join(F.broadcast(pieces), "piece")  # the file's pieces
    places = F.shiftleft(F.col("s").cast("long"), END_BITS).bitwiseOR((F.col("s") + F.col("l")).cast("long"))
    edge = F.col("top").bitwiseOR(F.shiftleft(places, ID_BITS))
    return met.select("word", "n", edge.alias("edge")).groupBy("word", "n").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _fallback(table: PieceTable, char: Column) -> Column:
    """Ids of a character without a piece."""
    if table.bytes_from is None:
        return F.array(F.lit(table.unknown))
    code = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.conv(F.substr(code, i, F.lit(2)), 16, 10).cast("int") + table.bytes_from)


def _ids_between(table: PieceTable, stops: Column) -> Column:
    """Ids of the path through the sorted places ``stops``."""
    def ids(i: Column) -> Column:
        s, e = F.element_at(stops, i), F.element_at(stops, i + 1)
        places = F.shiftleft(F.shiftleft(s, END_BITS).bitwiseOR(e).cast("long"), ID_BITS)
        of = lambda p: F.get(F.filter("edges", lambda x: x.bitwiseAND(PLACES) == p), F.lit(0))
        edge = F.transform(F.array(places), of)  # each looked for once
        return F.transform(edge, lambda x: F.when(x.isNotNull(), F.array(_id(x))).otherwise(_fallback(table, F.substr("word", s + 1, F.lit(1)))))[0]

    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(stops) - 1), ids))


def merged_stops(edges_: Column, n: Column) -> Column:
    """The fold of BPE files. The state is the set of symbol borders, as bits."""
    def step(mask: Column, longer_: Column) -> Column:
        fits = F.filter(longer_, lambda x: (mask.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(mask.bitwiseAND(x["inner"])) == 1))
        return mask.bitwiseAND(F.bitwise_not(F.coalesce(F.get(fits, F.lit(0))["inner"], F.lit(0).cast("long"))))

    def bits(x: Column) -> Column:
        s, e = F.call_function("shiftleft", F.lit(1).cast("long"), _start(x)), F.call_function("shiftleft", F.lit(1).cast("long"), _end(x))
        return F.struct((e - s - s).alias("inner"), s.bitwiseOR(e).alias("ends"))

    longer = F.filter(F.transform(edges_, bits), lambda x: x["inner"] != 0)
    full = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n + 1))  # also for the longest words, where 1 << n + 1 is below 0
    mask = F.transform(F.array(longer), lambda e: F.aggregate(F.sequence(F.lit(1), n), full, lambda m, _: step(m, e)))[0]
    return F.transform(F.array(mask), lambda m: F.filter(F.sequence(F.lit(0), n), lambda i: F.call_function("getbit", m, i) == 1))[0]


def with_costs(edges_: Column, table: PieceTable) -> Column:
    """Edges as structs with the cost of their rank."""
    costs = F.array(*[F.lit(-float(s)) for s in sorted(set(table.scores), reverse=True)], F.lit(0.0))
    return F.transform(edges_, lambda x: F.struct(F.get(costs, F.shiftright(x, START_BITS + END_BITS + ID_BITS).cast("int")).alias("cost"), _start(x).alias("s"), _end(x).alias("e")))


def viterbi_stops(edges_: Column, n: Column, unknown_cost: float) -> Column:
    """The fold of unigram files: the cheapest way to each place and where it came from, then back."""
    never = F.lit(float("inf"))
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, F.lit(0.0)).otherwise(never).alias("cost"), F.lit(-1).alias("back")))

    def place(ways: Column, e: Column) -> Column:
        cost = lambda s: F.element_at(ways, s + 1)["cost"]
        here = F.transform(F.filter(edges_, lambda x: x["e"] == e), lambda x: F.struct((cost(x["s"]) + x["cost"]).alias("cost"), x["s"].alias("back")))
        short = F.struct((cost(e - 1) + unknown_cost).alias("cost"), (e - 1).alias("back"))
        known = F.exists(edges_, lambda x: (x["e"] == e) & (x["s"] == e - 1))
        best = F.array_min(F.when(known, here).otherwise(F.array_append(here, short)))
        return F.transform(ways, lambda w, i: F.when(i == e, best).otherwise(w))

    ways = F.aggregate(F.sequence(F.lit(1), n), start, place)
    back = lambda w: F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda path, _: F.when(path[0] > 0, F.array_prepend(path, F.element_at(w, path[0] + 1)["back"])).otherwise(path))
    return F.transform(F.array(ways), back)[0]


def library_ids(words: list[str], path: str) -> list[list[int]]:
    """The library's ids of words, each as if it stood inside a text."""
    from sentencepiece import SentencePieceProcessor

    library = process_wide(f"library {path}", lambda: SentencePieceProcessor(model_file=path))
    blank = library.piece_to_id(BLANK)
    out = []
    for w in words:
        if w[0] == " ":  # the library puts the first blank itself
            out.append(library.encode(w[1:], num_threads=1))
        else:  # a word after a line break: shield it from that blank by a break
            got = library.encode("\n" + w, num_threads=1)
            out.append(got[(1 if got[0] == blank else 0) + len(library.encode("\n", num_threads=1)) - 1 :])
    return out


def encoded_words(words: DataFrame, table: PieceTable) -> DataFrame:
    """(word, n, ids) of every word of a table of distinct words and their counts."""
    short, long = words.filter(F.length("word") <= LATTICE_CHARS), words.filter(F.length("word") > LATTICE_CHARS)
    lattice = edges(short, table)
    known, n = F.col("edges"), F.length("word")
    if table.kind == UNIGRAM:
        worst = min(s for s, k in zip(table.scores, table.normal, strict=True) if k)
        stops = viterbi_stops(with_costs(known, table), n, 10.0 - worst)
    else:
        stops = merged_stops(known, n)
    ids = F.transform(F.array(stops), lambda x: _ids_between(table, x))[0]

    def by_library(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = library_ids(batch.column("word").to_pylist(), table.path)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(out, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return lattice.select("word", "n", ids.alias("ids")).unionByName(long.select("word", "n").mapInArrow(by_library, "word string, n long, ids array<int>"))


# ---- texts ----

class Vocabulary:
    """Frequent words as arrays: sorted hashes, and the ids of each."""

    def __init__(self, words: pa.StringArray, ids: pa.ListArray):
        words = words.cast(pa.large_string())  # offsets of 64 bits, whatever the session gives
        starts = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if len(words) else np.empty(0, dtype=np.uint8)
        parts = [np.empty(0, dtype=np.uint64)]
        for i in range(0, len(words), 50_000):
            ends = starts[i : i + 50_001]
            parts.append(_whole_hashes(data[ends[0] : ends[-1]], ends - ends[0]))
        hashes = np.concatenate(parts)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        at = ids.offsets.to_numpy().astype(np.int64) if len(ids) else np.zeros(1, dtype=np.int64)
        sizes = np.diff(at)[order]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(at[:-1][order] - bounds[:-1], sizes) + np.arange(bounds[-1])
        flat = ids.values.to_numpy(zero_copy_only=False).astype(np.int32)[take] if len(ids) else np.empty(0, dtype=np.int32)
        # every worker holds these
        self.ids = flat.astype(np.int16) if not len(flat) or flat.max() < 1 << 15 else flat
        self.bounds = bounds.astype(np.int32) if bounds[-1] < 1 << 31 else bounds

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _whole_hashes(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes, as ``words_in`` would give it."""
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return _hash(bounds[:-1], bounds[1:], sums, inverses)


def most_frequent(words: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The rows of the most frequent words, at most ``most`` of them, and none longer than a lattice: so their bytes are bounded.

    Words are counted by frequency (from 10,000 on by powers of two), and all of the ranges that fit are taken; if even the highest
    range holds more, the most frequent words of it, ties by word. Other words are encoded in the tasks of their texts.
    """
    short = words.filter(F.length("word") <= LATTICE_CHARS)
    power = F.floor(F.log2(F.col("n") / F.lit(COUNTED_APART)))
    low = F.when(F.col("n") < COUNTED_APART, F.col("n")).otherwise((F.lit(COUNTED_APART) * F.pow(F.lit(2.0), power)).cast("long"))
    by_count = sorted(((r.n, r.w) for r in short.groupBy(low.alias("n")).agg(F.count("*").alias("w")).collect()), reverse=True)
    least, held = None, 0
    for n, count in by_count:
        held += count
        if held > most:
            break
        least = n
    if least is None:
        return short.filter(F.col("n") >= (by_count[0][0] if by_count else 0)).orderBy(F.desc("n"), "word").limit(most)
    return short.filter(F.col("n") >= least)


def vocabulary(encoded: DataFrame) -> Vocabulary:
    """All words of a bounded table of words and ids."""
    got = encoded.select("word", "ids").toArrow()
    if not got.num_rows:
        return Vocabulary(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))
    return Vocabulary(*[pa.concat_arrays(got.column(c).chunks) for c in ("word", "ids")])


def frequent_words(encoded: DataFrame, most: int = FREQUENT) -> Vocabulary:
    """The most frequent words of a table of encoded words."""
    return vocabulary(most_frequent(encoded, most))


def rare_ids(words: list[str], lattice: Lattice, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds by word) of words in a task: by their lattice, or by the library where that would be long."""
    ids, bounds = lattice.encode([w if len(w) <= LATTICE_CHARS else "" for w in words])
    long = [i for i, w in enumerate(words) if len(w) > LATTICE_CHARS]
    if not long:
        return ids, bounds
    own, sizes = library_ids([words[i] for i in long], path), np.diff(bounds)
    sizes[long] = [len(x) for x in own]
    stops = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.empty(stops[-1], dtype=np.int32)
    is_long = np.zeros(len(words), dtype=bool)
    is_long[long] = True
    by_id = np.repeat(is_long, sizes)
    whole[~by_id] = ids
    whole[by_id] = [i for x in own for i in x]
    return whole, stops


def text_ids(texts: list[str], known: Vocabulary, lattice: Lattice, path: str) -> Iterator[np.ndarray]:
    """The ids of each text: words of the table by their hash, the others of a chunk of texts encoded once."""
    for a, b in chunks(texts, CUT_CHARS):
        data, starts, ends, hashes, bounds = words_in(texts[a:b])
        at, raw = known.find(hashes), data.tobytes()
        hit, missed = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        _, first, number = np.unique(hashes[missed], return_index=True, return_inverse=True)
        own = missed[first]
        rare, cuts = rare_ids([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)], lattice, path)
        sizes = np.empty(len(at), dtype=np.int64)
        for places, where, stops in ((hit, at[hit], known.bounds), (missed, number, cuts)):
            sizes[places] = stops[where + 1] - stops[where]
        out_stops = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(out_stops[-1], dtype=np.int32)
        for places, where, stops, source in ((hit, at[hit], known.bounds, known.ids), (missed, number, cuts, rare)):
            n = sizes[places]
            before = runs(n)
            out[np.repeat(out_stops[places], n) + before] = source[np.repeat(stops[where], n) + before]
        for i in range(b - a):
            yield out[out_stops[bounds[i]] : out_stops[bounds[i + 1]]]


def decode(ids: np.ndarray, pieces: list[bytes]) -> str:
    """The text of ids: pieces and byte pieces joined, without the blank in front."""
    text = b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def piece_bytes(table: PieceTable) -> list[bytes]:
    out = [p.encode() if n else b"" for p, n in zip(table.pieces, table.normal, strict=True)]
    if table.bytes_from is not None:
        out[table.bytes_from : table.bytes_from + 256] = [bytes([b]) for b in range(256)]
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """(doc_id, n_ids, ids, decoded_sha256, exact) of every row; ``exact``: decoding gives the text back."""
    from hashlib import sha256

    spark = docs.sparkSession
    small_batches(spark)
    table = PieceTable.read(path)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = written(word_counts(rows.select("text")), "words")
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPED_IN_MEMORY)):
        shared = spark.sparkContext.broadcast((vocabulary(encoded_words(most_frequent(counts, most), table)), Lattice(table, table.kind == UNIGRAM)))
    discard(counts)
    release(spark)
    kept = np.dtype(np.int16 if len(table.pieces) <= 1 << 15 else np.int32)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text as ids, with a digest to compare with what they decode to."""
        for batch in batches:
            source = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([ids.astype(kept).tobytes() for ids in text_ids(_blanked(source), *shared.value, path)], pa.binary()),
                pa.array([sha256((s or "").encode("utf-8", "surrogatepass")).digest() for s in source], pa.binary()),
            ], names=["id", "marks", "digest"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_bytes(table)
        for batch in batches:
            out = [np.frombuffer(raw.as_buffer(), dtype=kept).astype(np.int32) for raw in batch.column("marks")]
            back = [sha256(decode(ids, pieces).encode("utf-8", "surrogatepass")) for ids in out]
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in out])])
            flat = np.concatenate(out) if out else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(np.diff(cuts), pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)),
                pa.array([x.hexdigest() for x in back], pa.string()),
                pa.array([x.digest() == d for x, d in zip(back, batch.column("digest").to_pylist(), strict=True)], pa.bool_()),
            ], names=["doc_id", "n_ids", "ids", "decoded_sha256", "exact"])

    # written once, so that a result read again does not run the rare words' lattice again
    begun = written(rows.mapInArrow(begin, "id long, marks binary, digest binary"), "rare-words")
    return begun.mapInArrow(finish, "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, exact boolean")
