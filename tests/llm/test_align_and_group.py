"""Cross-tokenizer alignment, SimHash classes and spelling variants against plain forms."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from llm_helpers import ODD_ROWS, by_id, documents, no_docs, odd_docs, prose
from tokenizers import Tokenizer

from pharmatext.llm import alignment, simhash, variants
from pharmatext.llm.queries import QUERIES, tokenizer_file

BPE, SPM = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


# ---- alignment ----

def plain_alignment(rows):
    """All tokens of both libraries, cut where both end, and every count by dictionaries."""
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=SPM)
    sign = {s: bytes([b]) for s, b in alignment.byte_of_sign().items()}
    of_piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    found, count = [], Counter()
    for text in rows:
        a = [(t, b"".join(sign[c] for c in library.id_to_token(t))) for t in library.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(t, of_piece(pieces.id_to_piece(t))) for t in pieces.encode(text)] if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a = b = []
        ends = lambda tokens: np.cumsum([len(x) for _, x in tokens]).tolist()
        a_at, b_at = dict(zip(ends(a), [t for t, _ in a], strict=True)), dict(zip(ends(b), [t for t, _ in b], strict=True))
        cuts = sorted(set(a_at) & set(b_at))
        links = [(a_at[c], b_at[c]) for c in cuts]
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(t) for e, t in a_at.items() if low < e <= c) + "|" + ",".join(str(t) for e, t in b_at.items() if low < e <= c))
            low = c
        count.update(links)
        found.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(n_a, n_b, len(x), len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x), h) for n_a, n_b, x, h in found]


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_documents(spark, sf):
    docs = [d for d in documents(spark, sf) if len(d[1] or "") < 20_000]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    wanted = dict(zip([i for i, _ in docs], plain_alignment([t for _, t in docs]), strict=True))
    looked_up = {r.doc_id: tuple(r[c] for c in NUMBERS) for r in alignment.alignment(df, BPE, SPM).collect()}
    assert looked_up == wanted
    joined = {r.doc_id: tuple(r[c] for c in NUMBERS) for r in alignment.alignment(df, BPE, SPM, max_pairs=0).collect()}
    assert joined == wanted


def test_alignment_of_odd_rows(spark):
    more = [(100, "  two  blanks ▁ and 中文字 text\x85\xa0x", "a"), (101, "<s> </s> <|endoftext|><unk> <0x41>", None), (102, "\n\n\t x", None), (103, " ", "b"), (104, "naïve " * 3000, "b")]
    rows = ODD_ROWS + more
    wanted = defaultdict(list)
    for (doc_id, _, _), x in zip(rows, plain_alignment([r[1] for r in rows]), strict=True):
        wanted[doc_id].append(x)
    for most in (alignment.MAX_PAIRS, 0):
        found = by_id(alignment.alignment(odd_docs(spark, rows), BPE, SPM, max_pairs=most))
        assert {k: sorted(tuple(r[c] for c in NUMBERS) for r in v) for k, v in found.items()} == {k: sorted(v) for k, v in wanted.items()}
        assert found[4][0].n_a == 0 and found[4][0].groups_sha256 == ""
        assert alignment.alignment(no_docs(spark), BPE, SPM, max_pairs=most).collect() == []


def test_ids_equal_the_library(spark, sf):
    random_ = random.Random(3)
    tokens = alignment.ByteTokens(BPE)
    assert tokens.fast is not None
    signs = [chr(c) for c in [*range(0x250), 0x3000, 0x2028, 0x4E2D, 0x1F600, 0x301]]
    texts = ["".join(random_.choices(signs, k=200)) for _ in range(300)] + [t for _, t in documents(spark, sf)[:50]]
    for text in texts:
        assert tokens.ids(text).tolist() == tokens.library.encode(text, add_special_tokens=False).ids


def test_pointers_lead_to_the_end_of_long_chains():
    # tokens of 2 bytes, on one side moved by a byte: no ends meet before the last
    ends_a = np.append(np.arange(1, 2000, 2), 2000)
    ends_b = np.arange(2, 2001, 2)
    labels, rounds = alignment.terminals(ends_a, ends_b)
    assert set(labels.tolist()) == {len(ends_a) - 1} and rounds <= 13
    labels, _ = alignment.terminals(np.array([1, 3, 4]), np.array([3, 4]))
    assert labels.tolist() == [1, 1, 2, 1, 2]


# ---- SimHash ----

def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_classes(fingerprints, threshold=2):
    """Least place reachable, by comparing everything with everything."""
    values = np.array(fingerprints, dtype=np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= threshold).tolist():
            a, b = sorted((find(i), find(i + 1 + j)))
            root[b] = a
    return [find(i) for i in range(len(values))]


def test_simhash_of_all_documents(spark, sf):
    docs = documents(spark, sf)
    wanted = [plain_fingerprint(t) for _, t in docs]
    roots = plain_classes(wanted)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op12_simhash"](spark, sf).collect()}
    assert found == {docs[i][0]: (f"{wanted[i]:016x}", docs[roots[i]][0]) for i in range(len(docs))}


def test_golay_code_is_perfect_and_covers_pairs():
    balls = simhash.GolayBalls(2)
    words = np.random.default_rng(5).integers(0, 1 << 23, 500)
    place, code, over = balls.around(words, 2)
    assert (simhash.syndromes(code) == 0).all()
    assert (np.bincount(place[over == 0], minlength=500) == 1).all()
    distance = np.bitwise_count(code ^ words[place]).astype(int)
    assert (np.maximum(distance - 3, 0) == over).all()
    codewords = (lambda w: w[simhash.syndromes(w) == 0])(np.arange(1 << 23))
    assert len(codewords) == 1 << 12
    near = np.bitwise_count(codewords[None, :] ^ words[:20, None])
    assert [(near[i] <= 5).sum() for i in range(20)] == np.bincount(place, minlength=500)[:20].tolist()


@pytest.mark.parametrize("threshold", [0, 1, 2])
@pytest.mark.parametrize("crowded", [2, 512])
def test_links_of_dense_families(spark, threshold, crowded):
    random_ = random.Random(threshold)
    values = set()
    for _ in range(12):  # families around a centre, some of them crowded, and strangers
        centre = random_.getrandbits(64)
        values.update(centre ^ sum(1 << k for k in random_.sample(range(64), random_.randint(0, 4))) for _ in range(60))
    values.update(random_.getrandbits(64) for _ in range(200))
    values = sorted(values | {0, 1 << 63, 3 << 62})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "f long"), threshold, crowded).distinct().collect()
    place = {v: i for i, v in enumerate(signed)}
    pairs = [(place[r.a], place[r.b]) for r in found]
    assert all(bin((signed[i] ^ signed[j]) & (1 << 64) - 1).count("1") <= threshold for i, j in pairs)
    root = list(range(len(values)))
    for _ in range(len(values)):
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if before == root:
            break
    assert root == plain_classes(values, threshold)


def test_simhash_of_odd_rows(spark):
    found = by_id(simhash.near_classes(odd_docs(spark)))
    assert {k: {r.fingerprint for r in v} for k, v in found.items()} == {k: {f"{plain_fingerprint(t):016x}"} for k, t, _ in ODD_ROWS}
    assert {found[i][0].component_id for i in (1, 2, 3)} == {1}
    assert {found[i][0].component_id for i in (4, 5)} == {4} and found[4][0].fingerprint == "0" * 16
    assert [r.component_id for r in found[7]] == [7, 7]
    assert found[None][0].component_id is None
    assert simhash.near_classes(no_docs(spark)).collect() == []


# ---- spelling variants ----

def plain_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    holes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1:]].add(w)
            holes[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for hole, held in holes.items():
        for w in held:
            if "*" in hole:
                near[w] |= held - {w}
            elif hole in words:
                near[w].add(hole)
                near[hole].add(w)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: f for w, f in best.items() if words[f] >= 10 * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def rows_by_word(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_a_planted_vocabulary(spark):
    random_ = random.Random(8)
    letters = "abcdeÀéÿßz"
    bases = ["".join(random_.choices(letters, k=random_.randint(7, 11))) for _ in range(40)]
    words = []
    for base in bases:
        words += [base] * 200
        for _ in range(30):
            w = list(base)
            for _ in range(random_.randint(1, 3)):
                i = random_.randrange(len(w))
                w[i:i + 1] = random_.choice([[], [random_.choice(letters)], [w[i], random_.choice(letters)], [w[i], w[i]]])
            words += ["".join(w)] * random_.choice([1, 2, 3, 19, 20, 21])
    words += ["misspelling"] * 4000 + ["mispelling"] * 300 + ["mispeling"] * 25 + ["mispelin"] * 2 + ["mispellimg"] * 25 + ["mispellim"] * 2
    words += ["x" * 5000] * 3 + ["x" * 4999] * 40
    random_.shuffle(words)
    rows = [(i, " ".join(words[i::300])) for i in range(300)] + [(None, " ".join(words[:400])), (5, None), (6, ""), (6, "Spelling SPELLING-spelling1spelling ÀÀÀÀÀÀÀ àààààààà")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = plain_variants(rows)
    assert any(w[0] and w[1] != w[0] for w in wanted.values())
    assert rows_by_word(variants.variants(docs)) == wanted
    # shards one at a time, and a filter that is cut into shards by digest
    before = variants.SHARD_BYTES
    try:
        variants.SHARD_BYTES = 64
        assert max(map(variants.parts_of, Counter(map(len, wanted)).values())) > 1
        assert rows_by_word(variants.variants(docs, round_bytes=1 << 17)) == wanted
    finally:
        variants.SHARD_BYTES = before


def test_variants_of_odd_rows(spark):
    assert rows_by_word(variants.variants(odd_docs(spark))) == plain_variants([r[:2] for r in ODD_ROWS])
    assert variants.variants(no_docs(spark)).collect() == []
    assert rows_by_word(variants.variants(odd_docs(spark, [(1, prose(3, 400), "a")]))) == plain_variants([(1, prose(3, 400))])


def test_filters_hold_every_word():
    words = [f"word{i:05d}" for i in range(5000)]
    letters = np.frombuffer("".join(words).encode(), dtype=np.uint8).reshape(len(words), -1)
    h = variants.digests(letters)
    filled = np.zeros(variants.blocks_of(5000), dtype=np.uint64)
    block, bits = variants.place_and_bits(h, len(filled))
    np.bitwise_or.at(filled, block, bits)
    assert (filled[block] & bits == bits).all()
    others = variants.digests(np.frombuffer("".join(f"none{i:05d}" for i in range(20000)).encode(), dtype=np.uint8).reshape(20000, -1))
    block, bits = variants.place_and_bits(others, len(filled))
    assert (filled[block] & bits == bits).mean() < 0.05


# ---- storage ----

def test_tables_of_a_step_go_when_it_ends(spark):
    import os

    from pharmatext.llm.storage import scratch, written

    folder = lambda df: df.inputFiles()[0].removeprefix("file:").replace("///", "/").rsplit("/", 1)[0]
    with scratch(spark):
        first = written(spark.range(3), "first")
        second = written(first, "second", lasting=True)
        paths = folder(first), folder(second)
        assert all(map(os.path.exists, paths))
    assert [os.path.exists(p) for p in paths] == [False, True]
    assert second.count() == 3


# ---- the table of frequent words ----

def test_frequent_words_are_bounded_at_any_frequency(spark):
    from pharmatext.llm.pieces import frequent_words

    rows = [(f"often{i}", 10_000 + 3_000 * i, [i]) for i in range(20)] + [(f"same{i}", 500, [100 + i]) for i in range(9)]
    rows += [("l" * 100, 1 << 40, list(range(200, 290)))]  # too long for the table, however frequent
    words = spark.createDataFrame(rows, "word string, n long, ids array<int>")
    ids = lambda most: sorted(frequent_words(words, most).ids.tolist())
    assert ids(100) == [*range(20), *range(100, 109)]
    assert ids(28) == ids(21) == list(range(20))  # words of one frequency come together or not at all
    assert ids(3) == [17, 18, 19]  # the highest range alone holds more: its most frequent words
    assert frequent_words(words.filter("n < 0"), 5).ids.tolist() == []
