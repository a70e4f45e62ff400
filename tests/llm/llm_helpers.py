"""Small tables with every odd case: nulls, empty and long texts, repeated rows, ties, clashing names."""

import random
import re


WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau ups phi chi psi omega".split()


def prose(seed, n):
    random_ = random.Random(seed)
    return " ".join(random_.choice(WORDS) for _ in range(n))


ODD_ROWS = [
    (1, prose(1, 60), "a"), (2, prose(1, 60), "a"), (3, prose(1, 60).upper(), None), (4, None, "b"), (5, "", "b"), (6, "x", None),
    (7, prose(7, 60), "a"), (7, prose(7, 60), "a"), (8, prose(8, 4), "b"), (9, "!!! ??? ...", "c"), (10, prose(1, 30) + " " + prose(99, 1) + " " + prose(1, 60)[len(prose(1, 31)):], "c"),
    (None, prose(11, 50), "a"), (12, prose(12, 3000), "b"), (13, "wort" * 2000, "a"), (14, "é中😀 <|endoftext|> a\tb\r\nc\x00d  e", None),
]
SCHEMA = "doc_id long, text string, source string, id string, n int, node int, row int, word string, `key` string, size int, kept int, _found int, bands int"


def odd_docs(spark, rows=ODD_ROWS):
    """The rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "w", "k", 4, 5, 6, 7) for r in rows], SCHEMA)


def no_docs(spark):
    return odd_docs(spark, [])


def shingles(text, size=5):
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").lower())
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or ([tuple(words)] if words else [])


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


__all__ = ["ODD_ROWS", "by_id", "documents", "no_docs", "odd_docs", "prose", "shingles"]
