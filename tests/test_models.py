"""Features, learners and the classifier against plain Python forms on small tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import rows
from pharmatext.functions import text as rules
from pharmatext.operators import features, learners, metrics, naive_bayes
from pharmatext.operators.folds import stratified_folds
from pharmatext.plans.classifier import ModelSpec, TextClassifier, TrainedModel
from pharmatext.plans.dataset import TextDataset
from pharmatext.plans.joins import BROADCAST_BYTES
from pharmatext.streaming.jobs import classify_stream

TEXTS = [
    (1, "good pill works well, really good", 1.0), (2, "bad pain and bad rash", 0.0), (3, "works quickly", 1.0),
    (4, "the pain stayed", 0.0), (5, "good relief", 1.0), (6, "", 0.0), (7, "rash rash rash $5", 0.0), (8, "the and", 1.0),
    (9, "don't stop taking good pill", 1.0), (10, "worst pill ever", 0.0), (11, "unknown zzz", 1.0), (12, None, 0.0),
]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(TEXTS, "id bigint, text string, label double").repartition(3)


@pytest.fixture(scope="module")
def vectors(spark):
    words = ["good", "bad", "pain", "pill", "rash", "works", "well"]
    draw = np.random.default_rng(1)
    table = [(w, i, [float(x) for x in draw.normal(size=4)]) for i, w in enumerate(words)]
    return features.WordVectors.of(spark.createDataFrame(table, "term string, idx bigint, vec array<float>"))


def tokens_by_id(data):
    got = data.select("id", rules.tokens(F.col("text")).alias("t")).collect()
    return {r.id: r.t or [] for r in got}


def python_nb(train, test):
    """Multinomial naive Bayes, alpha 1, empirical prior: label -> rounded score per text."""
    labels = sorted({label for _, label in train})
    counts = {c: Counter(t for words, label in train if label == c for t in words) for c in labels}
    vocabulary = {t for c in labels for t in counts[c]}
    out = []
    for words in test:
        scores = []
        for c in labels:
            total = sum(counts[c].values()) + len(vocabulary)
            prior = math.log(sum(label == c for _, label in train) / len(train))
            scores.append(round(prior + sum(math.log((counts[c][t] + 1) / total) for t in words if t in vocabulary), 4))
        out.append((labels[scores.index(max(scores))], scores))
    return out


@pytest.mark.parametrize("limit", [BROADCAST_BYTES, 0])
def test_naive_bayes_equals_python(spark, data, limit):
    words = tokens_by_id(data)
    train = [(words[i], label) for i, _, label in TEXTS]
    scored = naive_bayes.fit(data).score(data, limit=limit).orderBy("id").collect()
    expected = python_nb(train, [words[r.id] for r in scored])
    assert len(scored) == len(TEXTS)
    for r, (label, scores) in zip(scored, expected):
        assert r.predicted == label
        assert r.scores == pytest.approx(scores, abs=2e-4)


def test_unseen_words_leave_the_prior_and_ties_go_low(spark):
    train = spark.createDataFrame([(1, "aa", 0.0), (2, "bb", 1.0)], "id bigint, text string, label double")
    test = spark.createDataFrame([(1, "zz yy"), (2, "bb"), (3, None)], "id bigint, text string")
    assert rows(naive_bayes.fit(train).predict(test)) == [(1, 0.0), (2, 1.0), (3, 0.0)]


@pytest.mark.parametrize("limit", [BROADCAST_BYTES, 0])
def test_cross_validation_equals_refits(spark, data, limit):
    folded = stratified_folds(data, 3)
    got = {r.id: (r.fold, r.predicted) for r in naive_bayes.cross_validate(folded, 3, limit=limit).collect()}
    fold, words = {r.id: r.fold for r in folded.collect()}, tokens_by_id(data)
    for f in range(3):
        train = [(words[i], label) for i, _, label in TEXTS if fold[i] != f]
        for i in (i for i in fold if fold[i] == f):
            assert got[i] == (f, python_nb(train, [words[i]])[0][0])


def test_two_thousand_classes_take_the_same_plan_as_two(spark):
    n = 2000
    wide = spark.range(2 * n).select(
        "id", F.format_string("word%d common word%d", F.col("id") % n, F.col("id") % n).alias("text"),
        (F.col("id") % n).cast("double").alias("label"))
    few = wide.filter("label < 2")
    size = lambda df: len(df._jdf.queryExecution().executedPlan().toString())
    model = naive_bayes.fit(wide)
    assert len(model.labels) == n and model.terms().filter("term = 'word7' AND label IN (7, 8)").count() == 2
    scored = model.score(wide.limit(300))
    assert scored.filter("predicted = id % 2000 AND size(scores) = 2000").count() == 300
    assert size(scored) < 1.5 * size(naive_bayes.fit(few).score(few))
    halves = wide.withColumn("fold", (F.col("id") >= n).cast("int"))
    checked = naive_bayes.cross_validate(halves, 2)
    assert checked.filter("predicted = label").count() == 2 * n


def test_labels_of_other_types_are_cross_validated(spark, data):
    named = data.withColumn("label", F.when(F.col("label") > 0, "good").otherwise("bad"))
    numbered = stratified_folds(data, 3)
    got = dict(rows(naive_bayes.cross_validate(numbered.drop("label").join(named.select("id", "label"), "id"), 3).select("id", "predicted")))
    expected = dict(rows(naive_bayes.cross_validate(numbered, 3).select("id", "predicted")))
    assert got == {i: "good" if x > 0 else "bad" for i, x in expected.items()}


def test_class_missing_from_a_training_part_is_never_predicted(spark):
    df = spark.createDataFrame([(1, "a1 b1", 0.0), (2, "a1", 0.0), (3, "c1", 1.0)], "id bigint, text string, label double")
    got = {r.id: r.predicted for r in naive_bayes.cross_validate(stratified_folds(df, 2), 2).collect()}
    assert got[3] == 0.0 and len(got) == 3


def test_bag_of_words_keeps_texts_without_terms(spark, data):
    train = data.filter("id <= 4")
    bow = features.BagOfWords.fit(train)
    words = tokens_by_id(data)
    known = {t for i in range(1, 5) for t in words[i]}
    assert bow.n_terms == len(known)
    assert [r.term for r in bow.with_index().orderBy("idx").collect()] == sorted(known)
    expected = []
    for i, found in words.items():
        counts = Counter(t for t in found if t in known)
        expected += [(i, t, n) for t, n in counts.items()] or [(i, None, 0)]
    for limit in (BROADCAST_BYTES, 0):
        assert sorted(map(str, rows(bow.transform(data, limit=limit)))) == sorted(map(str, expected))


def test_tag_lexicon_wins_over_the_rules(spark, data, tmp_path):
    lexicon = spark.createDataFrame([("pill", "VERB"), ("works", "VERB")], "term string, tag string")
    model = naive_bayes.fit(data, remove_tags=["VERB"], lexicon=lexicon)
    terms = {r.term for r in model.table.collect()}
    assert not {"pill", "works", "stayed", "taking"} & terms and "good" in terms
    before = rows(model.predict(data))
    assert len(before) == len(TEXTS)
    trained = TextClassifier("nb", "pos", remove_tags=["VERB"], lexicon=lexicon).fit(TextDataset(data), str(tmp_path / "m"))
    assert rows(trained.predict(data)) == rows(TrainedModel.load(spark, str(tmp_path / "m")).predict(data)) == before


def test_word_table_paths_agree(spark, data, vectors):
    words = tokens_by_id(data)
    table = {r.term: (r.idx, np.array(r.vec)) for r in vectors.table.collect()}
    for limit, join_limit in ((1 << 20, BROADCAST_BYTES), (0, BROADCAST_BYTES), (0, 0)):
        means = features.mean_vectors(data, vectors, limit=limit, join_limit=join_limit).collect()
        assert len(means) == len(TEXTS)
        for r in means:
            hits = [table[t][1] for t in words[r.id] if t in table]
            assert r.features.toArray() == pytest.approx(np.mean(hits, axis=0) if hits else np.zeros(4), abs=1e-6)
        found = features.tokens_to_indices(data, vectors, limit=limit, join_limit=join_limit)
        assert {r.id: r.indices for r in found.collect()} == {
            i: [table[t][0] + 1 if t in table else 0 for t in found] for i, found in words.items()}
        back = features.indices_to_tokens(found, vectors, limit=limit, join_limit=join_limit)
        assert {r.id: r.tokens for r in back.collect()} == {
            i: [t if t in table else None for t in found] for i, found in words.items()}


def test_lookup_table_starts_with_zeros(spark, vectors):
    got = {r.idx: r.vec for r in vectors.lookup().collect()}
    assert got[0] == [0.0] * 4 and sorted(got) == list(range(8))


@pytest.mark.parametrize("n", [24, 25, 26, 50])
def test_batches(spark, n):
    df = spark.createDataFrame([(i, [1] * (4 + (i * 7) % 9)) for i in range(n)] + [(900, [1, 2, 3]), (901, [1, 2, 3, 4])], "id bigint, indices array<int>")
    got = features.pad_batches(df).collect()
    assert 900 not in {r.id for r in got} and len(got) == n + 1
    order = [r for r in sorted(got, key=lambda r: r.place)]
    assert [r.length for r in order] == sorted(r.length for r in order)
    for r in got:
        assert r.batch == r.place // 25 and len(r.padded) == r.width == max(x.length for x in got if x.batch == r.batch)
        assert r.padded[r.length:] == [0] * (r.width - r.length)


def test_fourier_features_approach_the_kernel(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(6, 10))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, a array<double>").withColumn("features", array_to_vector("a"))
    mapped = learners.FourierFeatures(inputCol="features", outputCol="k", inputDim=10, numFeatures=8192, gamma=0.05)
    z = np.array([r.k.toArray() for r in mapped.transform(df).orderBy("id").collect()])
    exact = np.exp(-0.05 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - exact).max() < 0.05


@pytest.mark.parametrize("length", [0, 1, 3, 4, 9, 40])
def test_conv_pool_equals_loops(length):
    draw = np.random.default_rng(length)
    vectors = np.vstack([draw.normal(size=(5, 3)), np.zeros((1, 3))]).astype(np.float32)
    text = draw.integers(-1, 5, length)
    bank = learners._filter_bank(3, 1)
    padded = np.vstack([vectors[text] if length else np.zeros((0, 3)), np.zeros((max(0, 4 - length), 3))])
    expected = []
    for width, (w, b) in zip(learners.FILTER_WIDTHS, bank):
        responses = [padded[i:i + width].reshape(-1) @ w + b for i in range(len(padded) - width + 1)]
        expected.append(np.maximum(np.max(responses, axis=0), 0))
    for block in (7, 1024):
        assert learners.conv_pool(text, vectors, bank, block) == pytest.approx(np.concatenate(expected), abs=1e-6)


def test_conv_feature_paths_agree(spark, data, vectors):
    paths = [learners.conv_features(data, vectors, limit=limit, join_limit=join_limit)
             for limit, join_limit in ((1 << 20, BROADCAST_BYTES), (0, BROADCAST_BYTES), (0, 0))]
    first, *others = [{r.id: r.features.toArray() for r in p.collect()} for p in paths]
    assert len(first) == len(TEXTS)
    for other in others:
        assert all(other[i] == pytest.approx(first[i], abs=1e-5) for i in first)


PREDICTIONS = [(0.0, 0.0), (0.0, 1.0), (0.0, 9.0), (1.0, 1.0), (2.0, 1.0), (2.0, 0.0)]


def test_metrics_with_zero_cells_and_foreign_predictions(spark):
    df = spark.createDataFrame(PREDICTIONS, "actual double, predicted double")
    assert metrics.accuracy(df).first()[0] == pytest.approx(2 / 6)
    got = {r.label: (r.precision, r.recall, r.f1) for r in metrics.label_metrics(df).collect()}
    assert got[0.0] == pytest.approx((1 / 2, 1 / 3, 2 / 5))
    assert got[1.0] == pytest.approx((1 / 3, 1.0, 1 / 2))
    assert got[2.0] == (0.0, 0.0, 0.0) and 9.0 not in got
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion_matrix(df).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 5 and cells[2.0, 2.0] == 0


def test_summary_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.0, 1.0), (1, 1.0, 1.0), (1, 1.0, 0.0)], "fold int, actual double, predicted double")
    acc = metrics.cv_summary(df).filter("metric = 'accuracy'").first()
    assert (acc["mean"], acc["sd"]) == (0.75, 0.25)
    report = {r.metric: r.percent for r in metrics.validation_report(df).collect()}
    assert report["accuracy"] == "75.0000% +/- 25.0000%"
    assert {r.percent for r in metrics.evaluation_report(df).collect() if r.metric == "accuracy"} == {"75.00%"}


def test_specs():
    assert ModelSpec().checked().representation == "bow"
    assert ModelSpec("svm", "embeddings").checked().representation == "embedding"
    for bad in (ModelSpec("knn"), ModelSpec("cnn", "bow"), ModelSpec("nb", "matrix"), ModelSpec("nb", "pos")):
        with pytest.raises(ValueError):
            bad.checked()
    with pytest.raises(ValueError):
        ModelSpec("nb", "pos", ["NOPE"]).checked() and rules.check_tags(["NOPE"])


@pytest.mark.parametrize("learner, representation, tags", [
    ("nb", None, None), ("nb", "pos", ["VERB"]), ("rf", None, None), ("rf", "pos", ["VERB"]), ("svm", None, None), ("cnn", None, None)])
def test_saved_models_score_the_same(spark, data, vectors, tmp_path, learner, representation, tags):
    clf = TextClassifier(learner, representation, vectors if learner in ("svm", "cnn") else None, tags)
    dataset = TextDataset(data)
    model = clf.fit(dataset, output=str(tmp_path / "model"))
    before = rows(model.predict(data))
    longer = [i for i, words in tokens_by_id(data).items() if learner != "cnn" or len(words) > 3]
    assert sorted(i for i, _ in before) == sorted(longer) and {p for _, p in before} <= {0.0, 1.0}
    assert rows(TrainedModel.load(spark, str(tmp_path / "model")).predict(data)) == before
    found, matrix = clf.evaluate(dataset, str(tmp_path / "model"))
    assert found.count() == 7 and matrix.count() == 4
    with pytest.raises(Exception):
        TrainedModel.load(spark, str(tmp_path / "nowhere"))


def test_forest_separates_separable_texts(spark):
    df = spark.createDataFrame([(i, "alpha beta" if i % 2 else "gamma delta", float(i % 2)) for i in range(40)], "id bigint, text string, label double")
    model = TextClassifier("rf").fit(TextDataset(df))
    assert all(r.label == r.predicted for r in model.predict(df, keep=["label"]).collect())


def test_svm_learns_a_ring(spark):
    """A circle inside a ring: no straight line separates them, the kernel does."""
    draw = np.random.default_rng(3)
    angle, inner = draw.uniform(0, 2 * np.pi, 200), np.arange(200) % 2
    radius = np.where(inner == 1, 1.0, 6.0) + draw.normal(0, 0.2, 200)
    points = [(i, [float(r * np.cos(a)), float(r * np.sin(a))], float(k)) for i, (r, a, k) in enumerate(zip(radius, angle, inner))]
    df = spark.createDataFrame(points, "id int, a array<double>, label double").withColumn("features", array_to_vector("a"))
    model = learners.fit_svm(df, 2, gamma=0.1, n_features=256, max_iter=50)
    got = learners.predict(model, df, ["label"]).collect()
    assert sum(r.label == r.predicted for r in got) >= 195


def test_validate_other_learners_by_refits(spark, data):
    summary, matrix = TextClassifier("rf").validate(TextDataset(data), 2)
    assert summary.count() == 7 and sum(r.n for r in matrix.collect()) == len(TEXTS)
    summary, matrix = TextClassifier().validate(TextDataset(data), 3)
    assert summary.count() == 7 and sum(r.n for r in matrix.collect()) == len(TEXTS)


def test_classify_writes_a_report_and_needs_no_labels(spark, data, tmp_path):
    clf = TextClassifier()
    model = clf.fit(TextDataset(data))
    some = data.filter("text is not null")
    clf.classify(TextDataset(some), model, str(tmp_path / "with"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "with")).collect()]
    assert "Comment: works quickly" in lines and "Predicted Class: 1\tActual Class: 1" in lines
    assert lines.count("") == some.count()
    plain = clf.classify(TextDataset(some.drop("label")), model, str(tmp_path / "without"))
    assert plain.columns == ["id", "text", "predicted"] and plain.count() == some.count()


def test_stream_scores_equal_batch_scores(spark, data, tmp_path):
    model = TextClassifier().fit(TextDataset(data))
    data.select("id", "text").repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("id bigint, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    classify_stream(arriving, model, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "predicted") == rows(model.predict(data), "id", "predicted")


def test_results_do_not_depend_on_partitions(spark, data):
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = data.repartition(parts)
        folded = stratified_folds(df, 3)
        return rows(folded, "id", "fold"), rows(naive_bayes.cross_validate(folded, 3)), rows(features.BagOfWords.fit(df).with_index())

    try:
        assert run(1) == run(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repeated_words_count_at_their_first_place_on_every_path(spark):
    from pharmatext.operators.features import WordVectors, indices_to_tokens, mean_vectors, tokens_to_indices

    table = spark.createDataFrame([("pill", 0, [1.0, 1.0]), ("dose", 1, [4.0, 4.0]), ("pill", 2, [9.0, 9.0])], "term string, idx bigint, vec array<float>")
    vectors = WordVectors.of(table)
    assert vectors.n_words == 2
    texts = spark.createDataFrame([(1, "dose pill"), (2, "pill pill unknown")], "id bigint, text string")
    for limit in (1 << 27, 0):
        got = {r.id: (r.indices) for r in tokens_to_indices(texts, vectors, limit=limit, join_limit=limit).collect()}
        assert got == {1: [2, 1], 2: [1, 1, 0]}
        back = indices_to_tokens(tokens_to_indices(texts, vectors), vectors, limit=limit, join_limit=limit)
        assert {r.id: r.tokens for r in back.collect()} == {1: ["dose", "pill"], 2: ["pill", "pill", None]}
        means = {r.id: list(r.features) for r in mean_vectors(texts, vectors, limit=limit, join_limit=limit).collect()}
        assert means == {1: [2.5, 2.5], 2: [1.0, 1.0]}


def test_texts_without_a_label_do_not_count(spark):
    from pharmatext.operators import naive_bayes

    rows_ = [(i, f"word{i % 3} common", float(i % 2), i % 2) for i in range(12)]
    df = spark.createDataFrame(rows_, "id bigint, text string, label double, fold int")
    more = df.unionByName(spark.createDataFrame([(99, "stray other", None, 1)], df.schema))
    assert sorted(map(tuple, naive_bayes.fit(more).terms().collect())) == sorted(map(tuple, naive_bayes.fit(df).terms().collect()))
    assert sorted(map(tuple, naive_bayes.cross_validate(more, 2).collect())) == sorted(map(tuple, naive_bayes.cross_validate(df, 2).collect()))


def test_hash_width_and_depth_are_saved_with_the_model(spark, tmp_path):
    from pharmatext.plans.classifier import TextClassifier, TrainedModel
    from pharmatext.plans.dataset import TextDataset

    df = spark.createDataFrame([(i, f"good fine {i}" if i % 2 else f"bad awful {i}", float(i % 2)) for i in range(20)], "id bigint, text string, label double")
    TextClassifier("rf", hashed_terms=64, depth=3).fit(TextDataset(df), output=str(tmp_path / "m"))
    loaded = TrainedModel.load(spark, str(tmp_path / "m"))
    assert (loaded.spec.hashed_terms, loaded.spec.depth) == (64, 3)
    assert loaded.predict(df, keep=["label"]).filter("predicted != label").count() == 0
