import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pharmatext.functions import ratings, sites, text
from pharmatext.operators import clean, labelling, stats
from pharmatext.plans.dataset import ReviewDataset, TextDataset
from pharmatext.sources import text_files, word_vectors


def reviews(spark):
    return spark.createDataFrame([
        (1, "same", None), (2, "same", 1.0), (3, None, 1.0), (4, None, 2.0), (5, "", 1.0), (6, "  ", 0.0),
        (7, "ok", 1.0), (8, "ok", None),
    ], "id bigint, text string, label double")


def test_duplicates_go_before_empty_rows(spark):
    kept = rows(clean.clean(reviews(spark)), "id")
    assert kept == [(6,), (7,)]  # the first "same" has no label, so no "same" stays


def test_dedup_keeps_one_null_and_the_first_copy(spark):
    assert rows(clean.dedup_text(reviews(spark)), "id") == [(1,), (3,), (5,), (6,), (7,)]


def test_audit_adds_up(spark):
    a = clean.clean_audit(reviews(spark)).first()
    assert (a.rows_read, a.duplicates_removed, a.empty_removed, a.rows_kept) == (8, 3, 3, 2)


def test_dedup_combines_copies_before_the_shuffle(spark):
    plan = clean.dedup_text(reviews(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min(id") >= 1 and "SortAggregate" not in plan


STARS = [0.0, 1.0, 1.5, 2.0, 3.0, 4.0, 4.5, 5.0, None]


@pytest.mark.parametrize("classes, expected", [
    (2, [None, 0, None, 0, None, 1, None, 1, None]),
    (3, [1, 0, 1, 0, 1, 2, 1, 2, 1]),
    (5, [None, 0, None, 1, 2, 3, None, 4, None]),
])
def test_star_labels(spark, classes, expected):
    df = spark.createDataFrame(list(enumerate(STARS)), "id int, s double")
    got = df.select("id", ratings.star_label(F.col("s"), classes).alias("l")).orderBy("id").collect()
    assert [r.l for r in got] == expected


def test_threshold_label_and_bad_class_number(spark):
    df = spark.createDataFrame([(x,) for x in STARS], "s double")
    got = [r[0] for r in df.select(ratings.label_threshold(F.col("s"))).collect()]
    assert got == [0, 0, 0, 0, None, 1, 1, 1, None]
    with pytest.raises(ValueError):
        ratings.star_label(F.col("s"), 4)


def test_rating_text_map_and_scalar(spark):
    df = spark.createDataFrame(
        [(1, "{'effectiveness': 4.0, 'ease of use': None}"), (2, "{'effectiveness': 2}"), (3, None)],
        "id int, rating string")
    got = rows(labelling.explode_ratings(df))
    assert got == [(1, None, 4.0), (2, None, 2.0), (3, None, None)]
    scalar = spark.createDataFrame([(1, 7.5)], "id int, rating double")
    assert labelling.explode_ratings(scalar.withColumn("rating", F.col("rating").cast("string"))).columns == ["id", "rating"]


def test_label_is_added_once(spark):
    df = spark.createDataFrame([(1, 5.0, 0.0)], "id int, effectiveness double, label double")
    assert rows(labelling.label_stars(df)) == [(1, 5.0, 0.0)]


def test_stats(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (1.0,)], "label double")
    assert rows(stats.label_stats(df)) == [(0.0, 1, 25.0), (1.0, 3, 75.0)]


TOKEN_CASES = [
    ("I don't LIKE it's taste", ["n't", "like", "'s", "taste"]),
    ("the and of", []),
    ("... ,;!", []),
    ("$5 10mg + can't", ["$", "5", "10mg", "+", "ca", "n't"]),
    ("Schön ñandú", ["schön", "ñandú"]),
    ("", []),
]


@pytest.mark.parametrize("raw, expected", TOKEN_CASES)
def test_tokens(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.tokens(F.col("t"))).first()[0] == expected


def test_tags(spark):
    words = ["10", "$", "quickly", "walking", "pained", "usable", "reaction", "movement", "pill", "n't", "would"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(text.rule_tag(F.col("w"))).collect()]
    assert got == ["NUM", "SYM", "ADV", "VERB", "VERB", "ADJ", "NOUN", "NOUN", "NOUN", "PART", "AUX"]
    with pytest.raises(ValueError):
        text.check_tags(["VERBS"])


NAMES = [
    ("actos", "actos", "actos", "actos", "actos"),
    ("Methotrexate Vial", "methotrexate%20vial", "methotrexate+vial", "methotrexate-vial", "methotrexate"),
    ("12.5CPD-1DCPM-30PSE", "12%2e5cpd%2d1dcpm%2d30pse", "12%2e5cpd%2d1dcpm%2d30pse", "12.5cpd-1dcpm-30pse", "12.5cpd-1dcpm-30pse"),
    ("Ortho Tri-Cyclen Lo ", "ortho%20tri%2dcyclen%20lo%20", "ortho+tri%2dcyclen+lo", "ortho-tri-cyclen-lo-", "ortho"),
    ("a\tb😀x", "a%9b%1f600x", "a+b%1f600x", "a-b😀x", "a"),
]


@pytest.mark.parametrize("case", NAMES)
def test_search_keys(spark, case):
    name, *expected = case
    df = spark.createDataFrame([(name,)], "n string")
    keys = df.select(*[sites.search_key(F.lit(s), F.col("n")) for s in ("webmd", "drugs", "everydayhealth", "drugratingz")])
    assert list(keys.first()) == expected
    python_rule = "".join(x if x.isalnum() else hex(ord(x)).replace("0x", "%") for x in name.lower())
    assert keys.first()[0] == python_rule


def test_short_names_are_measured_raw(spark):
    df = spark.createDataFrame([("ACE",), ("ACE ",), ("actos",)], "n string")
    assert rows(df.filter(sites.long_enough(F.col("n")))) == [("ACE ",), ("actos",)]


def test_csv_round_trip_keeps_order_and_finds_gaps(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('comment,label\n"two\nlines, ""quoted""",1\nNA,1\n  padded ,0\n"x",N/A\n', encoding="utf8")
    table = text_files.read_csv(spark, str(path), "comment string, label double", id_col="id")
    assert rows(table, "id", "comment", "label") == [
        (0, 'two\nlines, "quoted"', 1.0), (1, None, 1.0), (2, "  padded ", 0.0), (3, "x", None)]
    data = TextDataset.read_csv(spark, str(path), "comment", "label", "comment string, label double")
    assert rows(data.table, "id") == [(0,), (2,)]
    data.write_csv(str(tmp_path / "out"))
    again = text_files.read_csv(spark, str(tmp_path / "out"), "comment string, label double")
    assert rows(again) == rows(data.table, "comment", "label")
    with pytest.raises(Exception):
        text_files.read_csv(spark, str(tmp_path / "missing.csv"), "a string")


def test_line_order_over_many_splits(spark, tmp_path):
    n = 5000
    (tmp_path / "lines.txt").write_text("\n".join(f"w{i}" for i in range(n)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = text_files.with_line_order(spark.read.text(str(tmp_path)), "line")
        assert lines.rdd.getNumPartitions() > 3
        assert rows(lines, "line", "value") == [(i, f"w{i}") for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_url_list_takes_exactly_one_source(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("https://a \n\nhttps://b\nhttps://c")
    path = str(tmp_path / "urls.txt")
    assert rows(text_files.url_list(spark, path)) == [("https://a",), ("https://b",), ("https://c",)]
    assert rows(text_files.url_list(spark, path, start=2)) == [("https://b",), ("https://c",)]
    assert rows(text_files.url_list(spark, urls=["x", "y"], start=1)) == [("y",)]
    for bad in ({}, {"path": path, "urls": ["x"]}):
        with pytest.raises(ValueError):
            text_files.url_list(spark, **bad)


def test_word_vectors_keep_file_order(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 2\nzeta 0.5 -1\nalpha 1e-3 2 \nmid 0 0\n")
    got = rows(word_vectors.read_word_vectors(spark, str(tmp_path / "v.txt")), "idx", "term", "vec")
    assert [(i, t) for i, t, _ in got] == [(0, "zeta"), (1, "alpha"), (2, "mid")]
    assert got[1][2] == pytest.approx([0.001, 2.0])


def test_review_dataset_from_old_csv(spark, tmp_path):
    (tmp_path / "old.csv").write_text(
        "comment,rating,date,drug\n"
        "good,\"{'effectiveness': 5.0, 'satisfaction': None}\",8/18/05,a\n"
        "bad,\"{'effectiveness': 1.0, 'satisfaction': 2.0}\",8/18/05,a\n"
        "meh,\"{'effectiveness': 3.0, 'satisfaction': 2.0}\",8/18/05,a\n")
    data = ReviewDataset.read_csv(spark, str(tmp_path / "old.csv"), "comment string, rating string, date string, drug string")
    assert rows(data.table, "comment", "label") == [("bad", 0.0), ("good", 1.0)]
    assert "rating" not in data.table.columns


def test_csv_types_without_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text,label,n,when,flag\nfine,1,2,2020-01-02,true\nbad,NaN,NA,2020-01-03,False\n")
    from pharmatext.sources.text_files import read_csv

    got = read_csv(spark, str(tmp_path))
    assert dict(got.dtypes) == {"text": "string", "label": "int", "n": "int", "when": "string", "flag": "boolean"}
    assert sorted(map(tuple, got.collect())) == [("bad", None, None, "2020-01-03", False), ("fine", 1, 2, "2020-01-02", True)]


def test_one_large_csv_gives_several_tasks_when_lines_are_rows(spark, tmp_path):
    from pharmatext.sources.text_files import read_csv

    (tmp_path / "b.csv").write_text("id,text\n" + "".join(f"{i},{'w' * 50}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        whole = read_csv(spark, str(tmp_path), "id bigint, text string")
        split = read_csv(spark, str(tmp_path), "id bigint, text string", multi_line=False)
        assert whole.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
        assert split.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_one_csv_file_read_by_byte_ranges(spark, tmp_path, limit):
    from pharmatext.sources import text_files

    draw = random.Random(4)
    signs = ["a", "b ", '"', "\n", ",", "é", '""', "\n\n", "NA", "x" * 30, "\r\n"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 40))) for _ in range(400)] + ["line\n" * 300, None, "", '"', "\n"]
    df = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts)], "id bigint, text string, n int")
    path, schema = str(tmp_path / "csv"), "id bigint, text string, n int"
    text_files.write_csv(df.coalesce(1), path)
    wanted = rows(text_files.read_csv(spark, path, schema))
    assert len(wanted) == len(texts)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("300", "1000", "5000"):
            for k in before:
                spark.conf.set(k, size if k.endswith("maxPartitionBytes") else "1")
            found = text_files.read_csv_split(spark, path, schema, limit)
            assert rows(found) == wanted
        assert text_files.csv_records(spark, path).select("file", "start").distinct().count() > 3
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
