"""Every registered query against its SQL twin."""

import math

import duckdb
import pytest

from pharmatext.operators.folds import stratified_folds
from registry import QUERIES, SQL
from registry.common import TEXTS_SQL, labelled, token_rows_sql
from registry.learning import FOLDS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    result = duck.execute(SQL[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(types) == columns
    assert {c: TYPES[t] for c, t in found.dtypes} == types
    order = [list(types).index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    assert got == expected
    assert got


LEARNERS = ["rf_fit_predict", "svm_fit_predict", "svm_multiclass", "conv_fit_predict"]


def test_only_learned_results_have_no_sql():
    assert sorted(set(QUERIES) - set(SQL)) == sorted([*LEARNERS, "cross_validate_rf"])


@pytest.mark.parametrize("name", LEARNERS)
def test_learners_score_every_row(spark, sf, name):
    """One row for each document that the learner can read, labelled or not; well beyond a constant answer on the labelled ones."""
    found = QUERIES[name](spark, sf).collect()
    wanted = {
        "svm_multiclass": "SELECT count(*) FROM embeddings",
        # the network reads texts of more than three tokens
        "conv_fit_predict": f"SELECT count(*) FROM (SELECT id FROM ({token_rows_sql(TEXTS_SQL)}) GROUP BY id HAVING count(*) > 3)",
    }.get(name, "SELECT count(*) FROM documents")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert len(found) == len({r.id for r in found}) == con.execute(wanted).fetchone()[0]
    known = [r for r in found if r.label is not None]
    labels = {r.label for r in known}
    assert {r.predicted for r in found} <= labels
    right = sum(r.predicted == r.label for r in known) / len(known)
    largest = max(sum(r.label == x for r in known) for x in labels) / len(known)
    assert right >= largest + 0.3 * (1 - largest)
    assert len({r.predicted for r in found}) == len(labels)


def test_folds_of_forests(spark, sf, duck):
    """Every labelled document is scored once, in its fold, by a forest that has not seen it."""
    found = QUERIES["cross_validate_rf"](spark, sf).collect()
    folds = {r.id: (r.fold, r.label) for r in stratified_folds(labelled(spark, sf).select("id", "label"), FOLDS).collect()}
    assert {r.id: (r.fold, r.actual) for r in found} == folds and len(found) == len(folds)
    # blind to its own fold: unlike rf_recall, it can't know every label, but knows more than chance
    right = sum(r.predicted == r.actual for r in found) / len(found)
    assert 0.5 < right < 1.0
