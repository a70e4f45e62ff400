"""The operators as queries over the given tables, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """For every document its class of near copies."""
    from pharmatext.llm.near_dedup import near_classes

    return near_classes(table(spark, sf, "documents")).drop("node")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity scores of all documents by a model of the labels that aren't held out."""
    from pharmatext.llm.toxicity import scores, train

    docs = table(spark, sf, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train(docs.select("doc_id", "text"), table(spark, sf, "labels").filter(~held_out))
    return scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op3_pieces")
def op3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    from pharmatext.llm.pieces import encode

    return encode(table(spark, sf, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and byte-level BPE tokens of every document."""
    from pharmatext.llm.token_counts import token_counts

    return token_counts(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that an earlier one holds."""
    from pharmatext.llm.suffix_dedup import without_repeats

    return without_repeats(table(spark, sf, "documents"))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)"""


@query("op5_pseudonyms")
def op5_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its personal values replaced by keyed pseudonyms."""
    from pharmatext.llm.pseudonyms import with_pseudonyms

    return with_pseudonyms(table(spark, sf, "documents").select("doc_id", "text"), key="a key of the caller's")


@query("op7_exact_dedup", EXACT_SQL)
def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """For every document the one that stays of those with the same text."""
    from pharmatext.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf, "documents"), source_path=f"{sf}/documents.parquet")


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, compared."""
    from pharmatext.llm.fingerprints import neighbour_likeness

    return neighbour_likeness(table(spark, sf, "documents"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    """For every document whether the resampling towards good text takes it."""
    from pharmatext.llm.quality import train, with_sample

    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf, "labels"))
    return with_sample(docs, model, drop_text=True)


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of every document."""
    from pharmatext.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf, "documents"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers give of every document."""
    from pharmatext.llm.alignment import alignment

    return alignment(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of every document, and its class of fingerprints linked to it."""
    from pharmatext.llm.simhash import near_classes

    return near_classes(table(spark, sf, "documents"))


VARIANTS_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
keyed AS (SELECT run, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2),
      lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 1 AS BIGINT), 1)) - 1) + strpos('0123456789ABCDEF', substr(x, CAST(2 * i + 2 AS BIGINT), 1)) - 1 AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM keyed, crc_table),
voc AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM voc),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS short FROM place),
holes AS (SELECT word, n, i, left(word, i - 1) || '*' || substr(word, i + 1) AS hole FROM place),
near AS (
  SELECT less.word, less.n, voc.word AS other, voc.n AS other_n FROM less JOIN voc ON short = voc.word
  UNION ALL SELECT voc.word, voc.n, less.word, less.n FROM less JOIN voc ON short = voc.word
  UNION ALL SELECT a.word, a.n, b.word, b.n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word),
ranked AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS rank FROM near),
best AS (SELECT word, n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM ranked WHERE rank = 1),
way AS (
  SELECT word, form AS reached FROM best WHERE form IS NOT NULL
  UNION ALL SELECT way.word, best.form FROM way JOIN best ON way.reached = best.word WHERE best.form IS NOT NULL),
ends AS (SELECT way.word, reached AS root FROM way LEFT JOIN best ON way.reached = best.word WHERE best.form IS NULL)
SELECT voc.word, form, coalesce(root, voc.word) AS root, voc.n, coalesce(n_near, 0) AS n_near, form_n
FROM voc LEFT JOIN best USING (word) LEFT JOIN ends USING (word)"""


@query("op13_variants", VARIANTS_SQL)
def op13_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents with the more frequent words that they are spelling variants of."""
    from pharmatext.llm.variants import variants

    return variants(table(spark, sf, "documents"))
