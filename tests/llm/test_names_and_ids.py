"""Documents whose own columns are named like those the operators make, and rows that share an id but not a text."""

from pyspark.sql import functions as F

from pharmatext.llm import exact_dedup, near_dedup, pseudonyms, quality
from llm_helpers import prose

NAMES = ["_id", "_label", "_digest", "_own", "_n", "_FOUND", "n_pseudonyms", "_near_id", "_near_n", "_quality_scored", "_s", "s", "mean"]


def clashing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(NAMES)])


def assert_passed_on(out, docs):
    assert out.select(*[f"`{c}`" for c in docs.columns]).columns == docs.columns
    for r in out.collect():
        assert [r[name] for name in NAMES] == list(range(len(NAMES)))


def test_exact_dedup_passes_columns_of_its_own_names_on(spark):
    docs = clashing(spark, [(1, "Same"), (2, "same"), (3, "other"), (3, "other")])
    kept = exact_dedup.kept_rows(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and kept.columns == docs.columns
    assert_passed_on(kept, docs)


def test_quality_passes_columns_of_its_own_names_on(spark):
    good, bad = [prose(i, 80) for i in range(8)], ["zz qq " * 40 + str(i) for i in range(8)]
    docs = clashing(spark, list(enumerate(good + bad)))
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(16) if i % 4], "doc_id long, quality int")
    kept = quality.kept_rows(docs, quality.train(docs, labels))
    assert {r.doc_id for r in kept.collect()} == set(range(8)) and kept.columns == docs.columns
    assert_passed_on(kept, docs)


def test_quality_labels_are_a_sample_at_any_number(spark, monkeypatch):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    monkeypatch.setattr(quality, "LABELLED_ROWS", 400)
    assert 300 < quality._labelled(labels, "quality", "doc_id").count() < 500
    monkeypatch.setattr(quality, "LABELLED_ROWS", 4000)
    assert quality._labelled(labels, "quality", "doc_id").count() == 4000


def test_pseudonyms_pass_columns_of_their_own_names_on(spark):
    docs = clashing(spark, [(1, "call 4111 1111 1111 1111 now"), (2, None)])
    out = pseudonyms.with_pseudonyms(docs, "key")
    assert_passed_on(out, docs)
    assert out.columns == [*docs.columns, "n_pseudonyms_"]
    found = {r.doc_id: r for r in out.collect()}
    assert found[1]["n_pseudonyms_"] == 1 and "4111 1111" not in found[1].text and found[2].text is None


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    a, b = prose(1, 80), prose(2, 80)
    docs = clashing(spark, [(0, b), (1, a), (1, b + " omega"), (2, prose(3, 80)), (2, prose(3, 80)), (3, prose(4, 80)), (3, prose(5, 80)), (None, prose(6, 80)), (None, prose(6, 80))])
    kept = near_dedup.kept_rows(docs)
    expected = [(0, b), (1, a), (2, prose(3, 80)), (3, prose(4, 80)), (3, prose(5, 80)), (None, prose(6, 80))]
    order = lambda pairs: sorted(pairs, key=lambda p: (p[0] is None, p[0] or 0, p[1]))
    assert order((r.doc_id, r.text) for r in kept.collect()) == order(expected)
    assert kept.columns == docs.columns
    assert_passed_on(kept, docs)
