"""Word tables of which only the first words fit in the workers: the other words' tokens are joined, no others."""

import numpy as np
import pytest

from pharmatext.operators import features, network
from pharmatext.operators.features import WordVectors

WORDS = [f"w{i}" for i in range(20)]


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(3)
    return WordVectors.of(spark.createDataFrame([(w, i, [float(x) for x in draw.normal(size=4)]) for i, w in enumerate(WORDS)], "term string, idx bigint, vec array<float>"))


@pytest.fixture(scope="module")
def texts(spark):
    draw = np.random.default_rng(4)
    rows = [(i, " ".join(WORDS[k] if k < 20 else "unknown" for k in draw.integers(0, 22, 3 * i))) for i in range(12)]
    return spark.createDataFrame([*rows, (50, None), (51, "w19 w19 w0 w19 w2")], "id bigint, text string")


def test_frequent_words_stay_in_the_workers_and_others_are_joined(vectors, texts, monkeypatch):
    half = vectors.n_bytes // 2
    for vec in (True, False):
        sent, cut = vectors.first_words(half if vec else half * 2 // 3, vec)
        assert 5 < cut < 15 and len(sent.value[0]) == cut
    joined = []
    real = features.join_table
    monkeypatch.setattr(features, "join_table", lambda rows, table, *rest: joined.append((rows, table)) or real(rows, table, *rest))
    got = {r.id: r.indices for r in features.tokens_to_indices(texts, vectors, limit=half // 2).collect()}
    whole = {r.id: r.indices for r in features.tokens_to_indices(texts, vectors).collect()}
    assert got == whole and got[51] == [20, 20, 1, 20, 3] and got[50] == []
    (rows, table), = joined
    _, cut = vectors.first_words(half // 2, False)
    assert cut > 0 and table.count() == 20 - cut
    assert not {r.term for r in rows.collect()} & set(WORDS[:cut])


def test_split_means_words_and_matrices_equal_whole_ones(vectors, texts):
    half = vectors.n_bytes // 2
    for join_limit in (1 << 27, 0):
        means = lambda limit: {r.id: list(r.features) for r in features.mean_vectors(texts, vectors, limit=limit, join_limit=join_limit).collect()}
        split, whole = means(half), means(1 << 27)
        assert split.keys() == whole.keys() and all(split[i] == pytest.approx(whole[i], abs=1e-12) for i in whole)
        sequences = features.tokens_to_indices(texts, vectors)
        words = lambda limit: {r.id: r.tokens for r in features.indices_to_tokens(sequences, vectors, limit=limit, join_limit=join_limit).collect()}
        assert words(half // 2) == words(1 << 27)
    table, cut = network.lookup_matrix(vectors, half)
    assert cut and len(table.value) == cut + 1
    plain = {r.idx + 1: r.vec for r in vectors.table.collect()}
    for batch in network.with_others(sequences, vectors, ["id"], cut, 1 << 27).toArrow().to_batches():
        for matrix, indices in zip(network.matrices_of(batch, table, 4), batch.column("indices").to_pylist()):
            assert matrix.tolist() == [plain.get(i, [0.0] * 4) for i in indices]


def test_places_and_widths_are_ranked_without_the_sequences(texts, vectors, monkeypatch):
    ranked = []
    real = features.with_global_rank
    monkeypatch.setattr(features, "with_global_rank", lambda df, *rest, **more: ranked.append(df.columns) or real(df, *rest, **more))
    sequences = features.tokens_to_indices(texts, vectors)
    batches = features.pad_batches(sequences, size=4).collect()
    assert ranked == [["_row", "length", "id"]]
    for b in {r.batch for r in batches}:
        own = [r for r in batches if r.batch == b]
        assert {r.width for r in own} == {max(r.length for r in own)} == {len(r.padded) for r in own}
