"""op3's rare words: encoded in the tasks of their texts, with the ids of the lattice in columns and of the library."""

import random

import pytest

from llm_helpers import ODD_ROWS, odd_docs
from pharmatext.llm import pieces
from pharmatext.llm.lattice import Lattice
from pharmatext.llm.queries import tokenizer_file

SPM = tokenizer_file("piece_bpe_32k.model")
NAMES = ["<unk>", " ", "a", "b", "ab", "ba", " a", " ab", "bab", "aa", "abab", "é"]
SCORES = [0.0, -3.0, -2.0, -2.5, -3.1, -3.1, -3.2, -4.4, -5.0, -3.9, -3.0, -3.1]


def own_table(kind, bytes_from=None):
    names = NAMES + [f"<{b}>" for b in range(256)] if bytes_from else NAMES
    return pieces.PieceTable("", tuple(names), tuple(SCORES + [0.0] * (len(names) - len(NAMES))), tuple(0 < i < len(NAMES) for i in range(len(names))), bytes_from, 0, kind)


@pytest.mark.parametrize("kind, bytes_from", [(pieces.UNIGRAM, None), (pieces.BPE, None), (pieces.BPE, len(NAMES))])
def test_arrays_give_the_ids_of_the_columns(spark, kind, bytes_from):
    table, random_ = own_table(kind, bytes_from), random.Random(4)
    words = sorted({" " + "".join(random_.choice("aabbé中😀x") for _ in range(random_.choice([0, 3, 8, 61]))) for _ in range(150)})
    want = {r.word: r.ids for r in pieces.encoded_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), table).collect()}
    ids, bounds = Lattice(table, kind == pieces.UNIGRAM).encode(words)
    assert {w: ids[bounds[i] : bounds[i + 1]].tolist() for i, w in enumerate(words)} == want


def test_rare_words_have_the_library_s_ids():
    from sentencepiece import SentencePieceProcessor

    library, table, random_ = SentencePieceProcessor(model_file=SPM), pieces.PieceTable.read(SPM), random.Random(5)
    known = [p for p, n in zip(table.pieces, table.normal, strict=True) if n and " " not in p]
    words = ["".join(random_.choice(known) for _ in range(random_.randint(1, 6))) for _ in range(20_000)]
    words += ["".join(chr(random_.choice([97, 101, 233, 1080, 20013, 128512, 0x10FFFF])) for _ in range(random_.randint(1, 90))) for _ in range(2_000)]
    ids, bounds = pieces.rare_ids([" " + w for w in words], Lattice(table, False), SPM)
    assert any(len(w) > pieces.LATTICE_CHARS for w in words)
    for i, w in enumerate(words):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(w)


def test_no_text_and_no_rare_word_is_shuffled(spark):
    """Only distinct words and counts travel: every join or exchange of texts cost disk in proportion to them."""
    rows = [*ODD_ROWS, *[(200 + i, f"once{i} " * 3 + "common", "a") for i in range(50)]]
    found = pieces.encode(odd_docs(spark, rows), SPM, most=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert found.count() == len(rows) and {r.doc_id for r in found.collect() if not r.exact} == set()
