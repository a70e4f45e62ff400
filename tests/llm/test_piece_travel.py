"""What op3 keeps: no tables that nothing reads any more."""

import os

from pharmatext.llm import pieces
from pharmatext.llm.queries import tokenizer_file


def test_spent_tables_go(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    names = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = names()
    docs = spark.createDataFrame([(i, f"word{i} common tail\n{'x' * (i % 70)}") for i in range(40)] + [(90, None)], "doc_id long, text string")
    found = pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), most=3)
    assert {n.rsplit("-", 1)[0] for n in names() - before} == {"rare-words"}
    assert found.count() == 41 and found.filter("not exact").count() == 0
