"""Near duplicates, components, mixing, pseudonyms, pieces and the pipeline."""

import itertools
import random
import re

import numpy as np
from llm_helpers import ODD_ROWS, by_id, documents, no_docs, odd_docs, prose, shingles
from pyspark.sql import functions as F

import corpus_pipeline
from pharmatext.llm import mixing, near_dedup, pieces, pseudonyms
from pharmatext.llm.components import components
from pharmatext.llm.queries import QUERIES, tokenizer_file
from pharmatext.llm.words import text_shingles

SPM = tokenizer_file("piece_bpe_32k.model")


def classes(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    random_ = random.Random(4)
    pairs = [(random_.randint(0, 300), random_.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert found == classes(pairs, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def weighted_classes(rows):
    """Brute force: all pairs that share a shingle, by weighted Jaccard similarity."""
    df, n = np.zeros(near_dedup.COUNTERS), len(rows)
    hashes = [np.unique(h, return_counts=True) for h in text_shingles([t for _, t in rows])]
    for h, _ in hashes:
        np.add.at(df, near_dedup._counters(h), 1)
    idf = near_dedup.idf_table(df, n)
    weights = [dict(zip(h.tolist(), (idf[near_dedup._counters(h)] * c).tolist(), strict=True)) for h, c in hashes]
    holders = {}
    for i, w in enumerate(weights):
        for s in w:
            holders.setdefault(s, []).append(i)
    edges = []
    for i, j in {p for held in holders.values() for p in itertools.combinations(held, 2)}:
        shared = sum(min(weights[i][s], weights[j][s]) for s in weights[i].keys() & weights[j].keys())
        if shared / (sum(weights[i].values()) + sum(weights[j].values()) - shared) >= 0.8:
            edges.append((rows[i][0], rows[j][0]))
    return classes(edges, [k for k, _ in rows])


def test_near_classes_of_all_documents(spark, sf):
    docs = documents(spark, sf)
    found = {r.doc_id: r.class_id for r in QUERIES["op1_near_dedup"](spark, sf).collect()}
    assert found == weighted_classes(docs)


def test_a_large_group_of_near_copies(spark):
    random_ = random.Random(2)
    base = prose(77, 120).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 150):  # from one to many changed words: links reach some, others stand alone
        words = list(base)
        for _ in range(1 + i % 9):
            words[random_.randrange(len(words))] = f"new{random_.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    wanted = weighted_classes(rows)
    wrong = [k for k in wanted if wanted[k] != found[k]]
    assert len(wrong) <= 2  # sampling may miss a link at the threshold


def test_no_link_inside_a_bucket_is_lost(spark):
    """Insertions, appended words and truncations inside a family whose members share a template."""
    random_ = random.Random(6)
    base = prose(78, 150).split()
    fresh = lambda n: [f"new{random_.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(36):  # one pair in each class, so no link stands in for another
        one = base + fresh(40)
        at = random_.randrange(len(base))
        for words in (one, (one + fresh(18), one[:at] + fresh(12) + one[at:], one[:-12])[k % 3]):
            rows.append((len(rows), " ".join(words)))
    narrow = spark.createDataFrame(rows, "id long, text string")
    df, n = near_dedup.document_frequencies(narrow.select("text"))
    idf = spark.sparkContext.broadcast(near_dedup.idf_table(df, n))
    signed = near_dedup.signatures(narrow, idf, near_dedup.BANDS, near_dedup.ROWS).withColumn("bands", F.array(F.lit(1).cast("long"))).cache()
    texts_of = lambda wanted: signed.join(wanted, "node").join(narrow, "id").select("node", "text")
    ids = {bytes(r.node): r.id for r in signed.collect()}
    edges = [(ids[bytes(r.a)], ids[bytes(r.b)]) for r in near_dedup.links(signed.select("node", "rarity", "bands"), texts_of, idf, 0.8).collect()]
    wanted = weighted_classes(rows)
    assert len(set(wanted.values())) < 50
    assert classes(edges, range(len(rows))) == wanted


def test_own_weight_is_held_by_no_other_text(spark):
    one = [f"a{i}" for i in range(60)]
    texts = spark.createDataFrame([(b"0" * 16, " ".join(one)), (b"1" * 16, " ".join(one + [f"b{i}" for i in range(20)])), (b"\xff" * 16, "one more text of its own")], "node binary, text string")
    idf = spark.sparkContext.broadcast(np.where(np.arange(near_dedup.COUNTERS) % 2, 1.0, 2.0).astype(np.float32))
    found = {bytes(r.node): r.own for r in near_dedup.own_weights(texts, idf, 0.3).collect()}
    own = {}
    for k, theirs in ((b"1" * 16, " ".join(one[-4:] + [f"b{i}" for i in range(20)])), (b"\xff" * 16, "one more text of its own")):
        own[k] = near_dedup._weigh(theirs, idf.value)[1].sum()
    assert b"0" * 16 not in found and set(found) == set(own)
    assert all(0 < found[k] <= own[k] for k in found)


def test_samples_agree_as_the_similarity_says():
    random_ = np.random.default_rng(1)
    sampler = near_dedup.Sampler(2000)
    for share in (0.2, 0.5, 0.8):
        common = random_.integers(0, 1 << 63, 600, dtype=np.uint64)
        a = np.sort(np.concatenate([common, random_.integers(0, 1 << 63, 100, dtype=np.uint64)]))
        keep = random_.random(len(common)) < share
        b = np.sort(np.concatenate([common[keep], random_.integers(0, 1 << 63, 50, dtype=np.uint64)]))
        weight = lambda h: 1.0 + (h % np.uint64(7)).astype(float)
        drawn = sampler.draw(np.concatenate([a, b]), np.concatenate([weight(a), weight(b)]), np.array([0, len(a), len(a) + len(b)]))
        wa, wb = dict(zip(a.tolist(), weight(a), strict=True)), dict(zip(b.tolist(), weight(b), strict=True))
        shared = sum(min(wa[s], wb[s]) for s in wa.keys() & wb.keys())
        assert abs((drawn[0] == drawn[1]).mean() - shared / (sum(wa.values()) + sum(wb.values()) - shared)) < 0.05


def test_near_classes_of_odd_rows(spark):
    found = by_id(near_dedup.near_classes(odd_docs(spark)))
    assert {r.class_id for k in (1, 2, 3) for r in found[k]} == {1}
    assert {r.class_id for k in (4, 5) for r in found[k]} == {4}
    assert len(found[7]) == 2 and {(r.class_id, r.class_size) for r in found[7]} == {(7, 2)}
    assert found[9][0].class_size == 1 and found[None][0].class_id is None
    assert near_dedup.near_classes(no_docs(spark)).count() == 0
    kept = near_dedup.kept_rows(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id < 9").collect()) == [1, 4, 6, 7, 8]


def word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Shares by weight; what is above three times a source's words is shared again."""
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}
    fixed, left = {}, sum(sizes.values())
    while True:
        free = [s for s in ordered if s not in fixed and sizes[s]]
        total = left - sum(fixed.values())
        share = {s: total * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: 0.0 for s in ordered} | fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark):
    sf = "/root/testdata/sf0.01"
    rows = by_id(QUERIES["op10_mixing"](spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sizes = {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + word_count(d.text)
    goal, taken = brute_targets(sizes), dict.fromkeys(sizes, 0)
    for d in docs:
        r, = rows[d.doc_id]
        assert r.size == word_count(d.text) and r.source_size == sizes[d.source]
        assert abs(r.target - goal[d.source]) < 1e-6 * goal[d.source]
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[d.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 0.1 * goal[s] + 60 for s in sizes)
    assert sorted(rows) == sorted(d.doc_id for d in docs)
    again = by_id(QUERIES["op10_mixing"](spark, sf))
    assert again == rows


def test_mixing_a_hot_source_rounds_in_several_levels(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"),
                                    F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"))
    mixed = mixing.mix_sources(docs)
    sums = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 100 and r.most <= 3 for r in sums)


def test_copies_have_the_chances_that_were_asked_for(spark):
    rows = spark.range(400).select(F.lit("s").alias("source"), F.col("id").alias("key"), (F.col("id") % 5 + 10).alias("size"), F.lit(1).alias("occ"), F.lit(0.3).alias("p"))
    total = sum(r.copies for seed in range(8) for r in mixing.pivotal_copies(rows, seed=seed * 100).collect())
    assert abs(total / 3200 - 0.3) < 0.02


def test_mixing_odd_rows(spark):
    docs = odd_docs(spark)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ODD_ROWS)
    sizes = {}
    for _, text, source in ODD_ROWS:
        sizes[source] = sizes.get(source, 0) + word_count(text)
    goal = brute_targets(sizes)
    assert all(abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source]) and 0 <= r.copies <= 3 for r in rows)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(no_docs(spark)).count() == 0 == mixing.mixed_rows(no_docs(spark)).count()
    blank = odd_docs(spark, [(1, None, "a"), (2, " ", None)])
    assert {(r.target, r.copies) for r in mixing.mix_sources(blank).collect()} == {(0.0, 0)}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def replaced(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonyms.with_pseudonyms(docs, key).orderBy("doc_id").collect()]


def test_pseudonyms_keep_format_and_links(spark):
    card, other = "4111111111111111", "9807915762804490"
    texts = [f"a {card} b", "4111 1111 1111 1111!!", other, "+1 (017) 555-7713", "192.168.0.1 and 300.1.1.1", "123-45-6789 000-12-3456", "2020-02-29 2021-02-29 29/02/2020 02/29/2020 31.12.1999", "x.y-7@mail.example.com", None, "", "plain words 12"]
    got = replaced(spark, texts)
    assert got == replaced(spark, texts) and got[0] != replaced(spark, texts[:1], "another key")[0]
    first = got[0].split()[1]
    assert first != card and luhn(first) and got[1] == f"{first[:4]} {first[4:8]} {first[8:12]} {first[12:]}!!"
    assert re.fullmatch(r"\d{16}", got[2]) and got[2] != other and not luhn(got[2])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[3]) and got[3] != texts[3]
    a, _, b = got[4].split()
    assert b == "300.1.1.1" and a != "192.168.0.1" and all(0 <= int(x) <= 255 for x in a.split("."))
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4} 000-12-3456", got[5])
    iso, invalid, dmy, mdy, dots = got[6].split()
    assert invalid == "2021-02-29" and dmy == "/".join(reversed(iso.split("-"))) and int(mdy.split("/")[1]) > 12 and dots != "31.12.1999"
    assert re.fullmatch(r"[a-z]\.[a-z]-\d@mail\.example\.com", got[7])
    assert got[8] is None and got[9:] == texts[9:]


def test_permutations_are_one_to_one(spark):
    numbers = spark.range(1000).select(F.format_string("%03d", "id").alias("s"))
    assert numbers.select(pseudonyms.permute_text(F.col("s"), "k", "x").alias("p")).distinct().count() == 1000
    assert spark.range(pseudonyms._SIDE**2).select(pseudonyms.permute_pair(F.col("id"), pseudonyms._SIDE, "k", "x").alias("p")).distinct().count() == pseudonyms._SIDE**2
    days = spark.range(2000).select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("s"))
    moved = days.select(pseudonyms.pseudonym(F.col("s"), "k").alias("p")).distinct()
    assert moved.count() == 2000 and moved.filter(F.try_to_timestamp("p", F.lit("yyyy-MM-dd")).isNull()).count() == 0


def test_pseudonyms_of_documents_and_odd_rows(spark, sf):
    docs = {k: t for k, t in documents(spark, sf)}
    rows = QUERIES["op5_pseudonyms"](spark, sf).collect()
    assert len(rows) == len(docs)
    blank = lambda t: re.sub("[0-9]", "9", re.sub(r"[^\s@]+@", "@", t))
    seen = {}
    for r in rows:
        assert len(r.text) == len(docs[r.doc_id]) or "." in r.text
        changed = re.findall(r"(?<!\d)\d{16}(?!\d)", docs[r.doc_id])
        for old, new in zip(changed, re.findall(r"(?<!\d)\d{16}(?!\d)", r.text), strict=True):
            assert seen.setdefault(old, new) == new != old
        if r.n_pseudonyms == 0:
            assert r.text == docs[r.doc_id]
    assert any(r.n_pseudonyms for r in rows) and len(set(seen.values())) == len(seen)
    odd = odd_docs(spark)
    out = pseudonyms.with_pseudonyms(odd, "k")
    assert out.columns == [*odd.columns, "n_pseudonyms"]
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (t for _, t, _ in ODD_ROWS)))
    assert pseudonyms.with_pseudonyms(no_docs(spark), "k").count() == 0
    assert blank("a@b") == "@b"


def test_piece_ids_are_the_library_s(spark, sf):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=SPM)
    docs = dict(documents(spark, sf))
    rows = QUERIES["op3_pieces"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.ids == library.encode(docs[r.doc_id]) and r.n_ids == len(r.ids) and r.exact


def test_piece_ids_of_odd_rows_in_both_tiers(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=SPM)
    more = ["   a", "a  \n b", "\n\n", "\t x", "tail ", "\n" + "q" * 100 + " x", "▁a", "a" * 62, " " * 40 + "a", "a" * 63 + "\n"]
    rows = [*ODD_ROWS, *[(100 + i, t, "a") for i, t in enumerate(more)]]
    for most in (1 << 20, 3, 0):
        found = pieces.encode(odd_docs(spark, rows), SPM, most=most).collect()
        want = sorted((str(k), library.encode(t or "")) for k, t, _ in rows)
        assert sorted((str(r.doc_id), list(r.ids)) for r in found) == want
        assert {r.doc_id for r in found if not r.exact} == {106}
    assert pieces.encode(no_docs(spark), SPM).count() == 0


def test_viterbi_is_the_best_path(spark):
    names = ["<unk>", " ", "a", "b", "ab", "ba", " a", " ab", "bab", "aa"]
    scores = [0.0, -3.0, -2.0, -2.5, -3.1, -3.3, -3.2, -4.4, -5.0, -3.9]
    table = pieces.PieceTable("", tuple(names), tuple(scores), tuple(i > 0 for i in range(len(names))), None, 0, pieces.UNIGRAM)
    random_ = random.Random(6)
    words = sorted({" " + "".join(random_.choice("abx") for _ in range(random_.randint(0, 7))) for _ in range(60)})
    found = {r.word: r.ids for r in pieces.encoded_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), table).collect()}
    cost = dict(zip(names[1:], scores[1:], strict=True))
    unknown = min(scores) - 10.0

    def best(word):
        way = [(0.0, [])] + [(-1e9, [])] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(e):
                piece = word[s:e]
                score = cost.get(piece, unknown if e - s == 1 else None)
                if score is not None:
                    way[e] = max(way[e], (way[s][0] + score, [*way[s][1], names.index(piece) if piece in cost else 0]), key=lambda x: x[0])
        return way[-1]

    for w in words:
        score = sum(scores[i] if i else unknown for i in found[w])
        assert abs(score - best(w)[0]) < 1e-9


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "mixing", "sentencepiece"]
    held, tables = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, sf)
        assert out.columns == docs.columns
        tables.append(out.collect())
        held = spark.createDataFrame(tables[-1], docs.schema)
    ids = [{r.doc_id for r in t} for t in tables]
    assert ids[3] <= ids[2] <= ids[1] <= ids[0]
    texts = [r.text.lower() for r in tables[1]]
    assert len(texts) == len(set(texts)) and len(set(texts)) == len({r.text.lower() for r in tables[0]})
    assert len(set(weighted_classes(sorted((r.doc_id, r.text) for r in tables[2])).values())) == len(tables[2])
    final = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in final) == sorted(r.doc_id for r in tables[3]) and all(r.exact for r in final)


def test_pipeline_on_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1), (12, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.columns == odd_docs(spark).columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), str(tmp_path)).count() == 0


def test_shingle_helper():
    assert shingles("A b, c d e F") == [("a", "b", "c", "d", "e"), ("b", "c", "d", "e", "f")]
