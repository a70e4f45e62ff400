"""Toxicity and quality: held-out accuracy, fairness, odd rows."""

import zlib

import numpy as np
from llm_helpers import ODD_ROWS, no_docs, odd_docs, prose

from pharmatext.llm import quality, toxicity
from pharmatext.llm.queries import QUERIES


def auc(scores, labels):
    good, bad = scores[labels == 1], scores[labels == 0]
    return float((good[:, None] > bad[None, :]).mean())


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    scores, y = np.array([s for s, _ in held]), np.array([x for _, x in held])
    assert auc(scores, y) > 0.97
    hits = (scores >= 0.7) & (y == 1)
    assert hits.sum() / y.sum() > 0.8 and hits.sum() / (scores >= 0.7).sum() > 0.95


def labelled_sentences():
    """Group terms stand in toxic sentences far more often than in others."""
    texts, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        group = ["muslim", "gay", "women", "black"][i // 4 % 4] if i % 10 < (8 if toxic else 1) else ""
        texts.append(f"{prose(i, 12)} {group} {'idiots' if toxic and i % 3 else ''} {'awful' if toxic else ''} {prose(i + 9000, 5)}")
        labels.append(int(toxic))
    return texts, labels


def fitted(texts, labels, **more):
    text, place, count = toxicity.features(texts)
    terms = [toxicity.features([t])[1] for t in toxicity.IDENTITY_TERMS]
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    named = [[k for k, p in enumerate(terms) if np.isin(p, place[a:b]).all()] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return toxicity.fit(text, place, np.log1p(count), np.array(labels), named, **more)


def test_swapped_terms_move_scores_less():
    texts, labels = labelled_sentences()
    fair, plain = fitted(texts, labels), fitted(texts, labels, fairness=0.0)
    neutral = [f"{prose(5000 + i, 12)} {term} {prose(6000 + i, 5)}" for i in range(20) for term in ("muslim", "gay", "women", "people")]
    spread = lambda model: model.score(neutral).reshape(20, 4).std(axis=1).mean()
    assert spread(fair) < 0.2 * spread(plain)
    assert (fair.score(neutral) >= 0.7).mean() <= (plain.score(neutral) >= 0.7).mean()
    assert auc(fair.score(texts), np.array(labels)) > 0.97


def test_toxicity_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (2, 0, "x"), (5, None, "x"), (999, 1, "x"), (12, 0, "x")], "doc_id long, toxic int, text string")
    scored = toxicity.scores(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (4, 5)}) == 1
    only = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r.predicted for r in toxicity.scores(docs, only).collect()} == {0}
    nothing = toxicity.train(no_docs(spark), labels.limit(0))
    assert toxicity.scores(no_docs(spark), nothing).count() == 0


def test_quality_keeps_good_and_drops_bad(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op9_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good, bad = [rows[r.doc_id].kept for r in labels if r.quality == 1], [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    assert abs(sum(r.kept for r in rows.values()) - sum((r.log_weight or -1) > 0 for r in rows.values())) <= 5


def test_quality_learns_from_half_of_the_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.filter("doc_id % 2 = 0"))
    held = labels.filter("doc_id % 2 = 1").select("doc_id", "quality")
    rows = quality.with_sample(docs.select("doc_id", "text"), model).join(held, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.98 and np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (12, 0), (12, 0), (7, 1), (5, None)], "doc_id long, quality int")
    kept = quality.kept_rows(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns
    assert not {4, 5} & {r.doc_id for r in kept.collect()}
    every = quality.kept_rows(docs, quality.train(docs, labels.filter("quality = 1")))
    assert every.count() == len(ODD_ROWS) - 2
    assert quality.kept_rows(no_docs(spark), quality.train(no_docs(spark), labels)).count() == 0


def test_kth_largest(spark):
    values = [float(x % 700) / 3 for x in range(9000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 13, 14, 4500, 9000):
        assert quality.kth_largest(df, "v", k, few=64) == sorted(values, reverse=True)[k - 1]
