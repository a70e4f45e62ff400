"""Token counts, fingerprints, exact dedup, suffix dedup: against brute force and on odd rows."""

import hashlib
import random

import numpy as np
import pytest
from llm_helpers import ODD_ROWS, by_id, documents, no_docs, odd_docs, prose, shingles
from pyspark.sql import functions as F

from pharmatext.llm import exact_dedup, fingerprints, suffix_dedup, token_counts
from pharmatext.llm.queries import QUERIES, tokenizer_file
from pharmatext.llm.words import text_shingles

BPE = tokenizer_file("byte_bpe_50k.json")


def library_count(texts):
    from tokenizers import Tokenizer

    return [len(e) for e in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts_of_all_documents(spark, sf):
    docs = documents(spark, sf)
    found = by_id(QUERIES["op4_token_counts"](spark, sf))
    for (key, text), n in zip(docs, library_count([t for _, t in docs]), strict=True):
        assert found[key] == [(key, len(text.encode()), n, n > 1024)]


def test_token_counts_of_odd_rows_and_signs(spark):
    found = by_id(token_counts.token_counts(odd_docs(spark), BPE))
    for (key, text, _), n in zip(ODD_ROWS, library_count([t for _, t, _ in ODD_ROWS]), strict=True):
        assert (key, len((text or "").encode()), n, n > 1024) in found[key]
    assert token_counts.token_counts(no_docs(spark), BPE).count() == 0
    signs = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'re", "a", "bé", "1", "²", "Ⅷ", "<|endoftext|>", "!!", "\U0001f600", "́", "中", "\r\n", "﻿"]
    random_ = random.Random(3)
    texts = ["".join(random_.choice(signs) for _ in range(random_.randint(0, 30))) for _ in range(3000)]
    counter = token_counts.TokenCounter(BPE, {"a": 1})
    assert [counter.count(t) for t in texts] == library_count(texts)


def test_shingles_are_those_of_the_text():
    texts = [t for _, t, _ in ODD_ROWS]
    made = list(text_shingles(texts))
    assert [len(x) for x in made] == [len(shingles(t)) for t in texts]
    names = {}
    for x, t in zip(made, texts, strict=True):
        for h, s in zip(x.tolist(), shingles(t), strict=True):
            assert names.setdefault(h, s) == s
    assert len(set(names.values())) == len(names)


def test_fingerprints(spark, sf):
    docs = documents(spark, sf)
    found = by_id(QUERIES["op8_fingerprints"](spark, sf))
    texts = [t for _, t in docs]
    near, following, prints = [], [], {}
    for i, (key, text) in enumerate(docs):
        after = texts[(i + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        row, = found[key]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        jaccard = lambda a, b: len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
        near.append(row.near_edited - jaccard(shingles(text), shingles(edited)))
        following.append(row.near_next - jaccard(shingles(text), shingles(after)))
    assert abs(np.mean(near)) < 0.01 and np.std(near) < 0.05 and np.std(following) < 0.05


def test_fingerprints_of_odd_rows(spark):
    rows = fingerprints.neighbour_likeness(odd_docs(spark)).collect()
    assert len(rows) == len(ODD_ROWS)
    order = sorted(((k, t or "") for k, t, _ in ODD_ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    wanted = sorted(hashlib.sha256(fingerprints.edited_text(t, order[(i + 1) % len(order)][1]).encode()).hexdigest() for i, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in rows) == wanted
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (4, 5, 9)} == {""}
    assert fingerprints.neighbour_likeness(no_docs(spark)).count() == 0
    lone = fingerprints.neighbour_likeness(odd_docs(spark, ODD_ROWS[:1])).first()
    assert lone.near_next == 1.0


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_groups_also_when_digests_collide(spark, digest_bytes):
    rows = [*ODD_ROWS, *[(100 + i, prose(i % 90, 9), "z") for i in range(300)]]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    found = exact_dedup.exact_groups(odd_docs(spark, rows), digest_bytes=digest_bytes).collect()
    groups = {}
    for key, text, _ in rows:
        groups.setdefault(lower(text), []).append(key)
    wanted = []
    for key, text, _ in rows:
        group = groups[lower(text)]
        keep = max((k for k in group if k is not None), default=None)
        wanted.append((key, keep, len(group), key == keep, hashlib.sha256(lower(text).encode()).hexdigest()))
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, found), key=order) == sorted(wanted, key=order)
    assert exact_dedup.exact_groups(no_docs(spark)).count() == 0


def test_exact_rows_that_stay(spark):
    docs = odd_docs(spark)
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns
    # of 1, 2 and 3 the last; of null and empty the last; of the repeated row one
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [3, 5, 6, 7, 8, 9, 10, None, 12, 13, 14]))


def test_suffix_order():
    random_ = random.Random(1)
    for _ in range(400):
        text = np.array([random_.randint(1, random_.choice([1, 2, 4, 200])) for _ in range(random_.randint(0, 60))], dtype=np.int64)
        assert suffix_dedup.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        for enough in (3, 9, 20):
            heads = [text[i : i + enough].tolist() for i in suffix_dedup.suffix_order(text, enough)]
            assert heads == sorted(heads) and len(heads) == len(text)


def without_repeats(rows, length=50):
    """Brute force over rows in order of their ids."""
    out, seen = [], {}
    for key, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1) if key is not None else ():
            if seen.get(raw[i : i + length], key) < key:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        for i in range(len(raw) - length + 1) if key is not None else ():
            seen.setdefault(raw[i : i + length], key)
    return out


def test_suffix_dedup(spark, sf):
    found = sorted(map(tuple, QUERIES["op6_suffix_dedup"](spark, sf).collect()))
    assert found == without_repeats(documents(spark, sf))


def test_suffix_order_of_more_names_than_a_packed_triple_holds():
    text = np.random.default_rng(3).permutation((1 << 21) + 1000) + 1
    assert (suffix_dedup.suffix_order(text) == np.argsort(text)).all()


def test_windows_of_hot_grams_give_the_same_rows(spark, monkeypatch):
    """A passage in many contexts, inside and at the ends of texts, and a row that stands twice."""
    random_ = random.Random(8)
    passage = prose(91, 30)
    rows = [(i, f"{prose(200 + i, random_.randrange(12))} {passage[random_.randrange(40):]} {prose(400 + i // 2, random_.randrange(30))}") for i in range(60)]
    docs = spark.createDataFrame(rows + [rows[7], (None, rows[3][1])], "doc_id long, text string")
    sorted_ = lambda df: sorted(map(tuple, df.collect()), key=str)
    wanted = sorted_(suffix_dedup.without_repeats(docs))
    assert sum(r[2] for r in wanted) > 1000

    def no_hot_gram(pieces):
        assert pieces.groupBy("gram").agg(F.countDistinct("id").alias("n")).filter("n > 5").isEmpty()
        return sort(pieces)

    sort = suffix_dedup._marks
    monkeypatch.setattr(suffix_dedup, "_marks", no_hot_gram)
    monkeypatch.setattr(suffix_dedup, "HOT_DOCUMENTS", 5, raising=False)
    assert sorted_(suffix_dedup.without_repeats(docs)) == wanted


def test_suffix_dedup_of_odd_rows(spark):
    rows = [*ODD_ROWS, (20, "wort" * 500 + prose(5, 40), "a"), (21, "a" * 700, "a"), (22, "b" + "a" * 300 + prose(5, 40), "a"), (23, "é" * 90, "a"), (24, "xé" + "é" * 60, "a")]
    ordered = sorted(((k, t) for k, t, _ in rows), key=lambda x: (x[0] is None, x[0] or 0))
    order = lambda r: tuple(str(x) for x in r)
    found = suffix_dedup.without_repeats(odd_docs(spark, rows))
    assert sorted(map(tuple, found.collect()), key=order) == sorted(without_repeats(ordered), key=order)
    assert suffix_dedup.without_repeats(no_docs(spark)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.without_repeats(odd_docs(spark, rows), with_text=True).collect()}
    assert kept[1] == prose(1, 60).encode() and kept[2] == b""
