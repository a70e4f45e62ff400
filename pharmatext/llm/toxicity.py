"""Toxicity: a sparse linear classifier of words, trained with swapped identity terms.

A text is described by its words and the first six and seven bytes of longer words (stems), each
hashed into ``2**BITS`` places, as ``ln(1 + count)``. Two steps fit the weights on labelled rows:

1. a penalised logistic fit that leaves most weights at 0 picks the places that matter;
2. a fit on those places alone, in which labelled sentences are also shown with every identity term
   swapped for another one. The squared change of the score under the swap is added to the loss
   (counterfactual regularisation), so that naming a group moves no score. Texts that name no group
   take part with an added mention, so terms that the labelled rows lack are regularised as well.

The fit reads about ``MAX_ROWS`` labelled rows at most (picked by a digest of the id); the driver gets
their hashed counts, not their texts. Scoring is one scan over whole texts. Null and empty texts get
the score of a text without words; equal texts score alike. Without both kinds of labels every score
is the share of positives. Repeated labels of one id each count; labels that are null don't.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pharmatext.llm.storage import small_batches
from pharmatext.llm.words import chunks, mix, stem_hashes

BITS, STEMS = 18, (6, 7)
MAX_ROWS = 8_000
#: Terms that name groups of people; each is one word as ``words`` sees them.
IDENTITY_TERMS = (
    "women men woman man female male girls boys gay lesbian bisexual transgender queer straight muslim muslims "
    "jewish jews christian christians catholic hindu buddhist atheist black white asian african latino hispanic "
    "immigrant immigrants refugees disabled blind deaf elderly teenagers"
).split()


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, count) of each text's words and stems, by text and place."""
    keys, counts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for a, b in chunks(texts):
        found = []
        for k, (hashes, text) in enumerate(stem_hashes(texts[a:b], STEMS)):
            place = mix(hashes ^ np.uint64(k + 1)) >> np.uint64(64 - BITS)
            found.append(((text.astype(np.int64) + a) << BITS) | place.astype(np.int64))
        key, count = np.unique(np.concatenate(found), return_counts=True)
        keys.append(key)
        counts.append(count)
    key = np.concatenate(keys)
    return key >> BITS, key & ((1 << BITS) - 1), np.concatenate(counts)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        text, place, count = features(texts)
        z = np.bincount(text, weights=np.log1p(count) * self.weights[place], minlength=len(texts)) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def _select(text: np.ndarray, place: np.ndarray, value: np.ndarray, y: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Places with a weight other than 0 after an L1-penalised logistic fit (accelerated proximal steps)."""
    n, size = len(y), 1 << BITS
    curve = 10.0 * max(1.0, np.bincount(place, weights=value * value, minlength=size).max() / n)
    w, bias = np.zeros(size), -2.0
    z, z_bias, t = w, bias, 1.0
    for _ in range(rounds):
        s = np.bincount(text, weights=value * z[place], minlength=n) + z_bias
        error = (1.0 / (1.0 + np.exp(-s)) - y) / n
        step = z - np.bincount(place, weights=value * error[text], minlength=size) / curve
        w_next = np.sign(step) * np.maximum(np.abs(step) - penalty / curve, 0.0)
        b_next = z_bias - error.sum() / curve
        t_next = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        z, z_bias = w_next + (t - 1.0) / t_next * (w_next - w), b_next + (t - 1.0) / t_next * (b_next - bias)
        w, bias, t = w_next, b_next, t_next
    return np.flatnonzero(w)


def swaps(named: list[list[int]], terms: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, change) of each text's features when its terms (by number) become other terms.

    A text that names no group gets one mention, which is swapped, so that every term is seen."""
    random = np.random.default_rng(seed)
    places = [features([t])[1] for t in terms]
    out = []
    for i, held in enumerate(named):
        for t in held or [int(random.integers(len(terms)))]:
            other = (t + 1 + int(random.integers(len(terms) - 1))) % len(terms)
            out += [(i, int(p), -np.log(2.0)) for p in places[t]] + [(i, int(p), np.log(2.0)) for p in places[other]]
    moved = np.array(out, dtype=np.float64).reshape(-1, 3)
    return moved[:, 0].astype(np.int64), moved[:, 1].astype(np.int64), moved[:, 2]


def fit(text: np.ndarray, place: np.ndarray, value: np.ndarray, labels: np.ndarray, named: list[list[int]], terms: list[str] = IDENTITY_TERMS,
        penalty: float = 1e-3, ridge: float = 1.0, fairness: float = 1.0, positive_weight: float = 4.0, rounds: int = 300, least_texts: int = 3) -> ToxicityModel:
    """Fit the model to texts given as sparse features, their labels and the terms they name."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return ToxicityModel(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    common = np.bincount(place, minlength=1 << BITS)[place] >= least_texts
    text, place, value = text[common], place[common], value[common]
    moved_text, moved_place, change = swaps(named, list(terms))
    # a term's places stay in the model, to be held down
    chosen = np.union1d(_select(text, place, value, y, penalty, rounds), moved_place)
    column = np.full(1 << BITS, -1)
    column[chosen] = np.arange(len(chosen))
    x = _dense(text, column[place], value, len(y), len(chosen))
    x[:, -1] = 1.0
    moves = _dense(moved_text, column[moved_place], change, len(y), len(chosen))
    hold = fairness * (moves.T @ moves)
    hold[np.diag_indices(len(chosen))] += ridge
    sample_weight = np.where(y > 0, positive_weight, 1.0)
    beta = np.zeros(len(chosen) + 1)
    for _ in range(20):  # Newton steps
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30.0, 30.0)))
        slope = x.T @ (sample_weight * (p - y)) + hold @ beta
        curve = (x * (sample_weight * p * (1.0 - p))[:, None]).T @ x + hold
        curve[np.diag_indices(len(beta))] += 1e-6
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    weights = np.zeros(1 << BITS)
    weights[chosen] = beta[:-1]
    return ToxicityModel(weights, float(beta[-1]))


def _dense(text: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, m: int) -> np.ndarray:
    """A matrix of the chosen columns, and one more that is 0."""
    out = np.zeros((n, m + 1))
    inside = column >= 0
    np.add.at(out, (text[inside], column[inside]), value[inside])
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of labelled texts, and the identity terms in them."""
    term_places = [features([t])[1] for t in IDENTITY_TERMS]
    for batch in batches:
        texts = batch.column("text").to_pylist()
        text, place, count = features(texts)
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        own = [place[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        named = [[k for k, p in enumerate(term_places) if np.isin(p, mine).all()] for mine in own]
        yield pa.RecordBatch.from_arrays([
            batch.column("id"), batch.column("label"), pa.array([p.astype(np.int32).tobytes() for p in own], pa.binary()),
            pa.array([count[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), pa.array(named, pa.list_(pa.int32())),
        ], names=["id", "label", "places", "counts", "named"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Fit on the labelled rows, on about ``max_rows`` of them if there are more."""
    small_batches(docs.sparkSession)
    marked = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    share = min(1.0, max_rows / max(1, marked.count()))
    marked = marked.filter(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")  # about max_rows ids
    got = rows.mapInArrow(_described, "id long, label int, places binary, counts binary, named array<int>").toArrow()
    got = got.sort_by([("id", "ascending"), ("label", "ascending")])
    places = [np.frombuffer(b, dtype=np.int32) for b in got.column("places").to_pylist()]
    text = np.repeat(np.arange(len(places), dtype=np.int32), [len(p) for p in places])
    place = np.concatenate([*places, np.empty(0, dtype=np.int32)])
    value = np.log1p(np.concatenate([*[np.frombuffer(b, dtype=np.int32) for b in got.column("counts").to_pylist()], np.empty(0, dtype=np.int32)])).astype(np.float32)
    return fit(text, place, value, np.array(got.column("label").to_pylist()), got.column("named").to_pylist())


def scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; one scan."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[id_col, "score", "predicted"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(score, f"`{id_col}` long, score double, predicted int")
