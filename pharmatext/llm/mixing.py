"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every row of a source gets the same copy probability (target words over the source's words): its
whole part is copied surely, the fractional parts are rounded together. Two rows at a time exchange
mass (in words) at random until one of them is whole (0 or 1 copy); the other carries the rest on.
Rows are paired within small blocks of like size; what each block leaves over is gathered in blocks
again, level by level, until one row of each size class is left. These last rows of a source (a few
hundred at most) are settled from the longest to the shortest, each taking over what the ones before
it left, so the words taken miss the target by about one short document.

Sizes are counts of maximal runs of non-blank characters; a null text has size 0. Sources are ordered
by code point, null last. Random numbers are digests of the row's key and the seed: reruns agree.
Repeated keys are told apart by their size and number of occurrence. A source without words has
target 0 and takes nothing. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pharmatext.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
BLOCK = 64


def size_of(text: Column) -> Column:
    """Number of words of a text."""
    # the runs are counted by their starts: no array of words is built
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Words to take of each source. All sources' words are shared by weight; a share above ``most``
    times the source's words stops there, and the excess is shared by weight among the others."""
    ordered = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    have = dict(ordered)
    left, free, out = float(sum(have.values())), {s for s, n in ordered if n > 0}, {s: 0.0 for s, _ in ordered}
    while free:
        whole = sum(weight[s] for s, _ in ordered if s in free)
        share = {s: left * weight[s] / whole for s, _ in ordered if s in free}
        full = {s for s, x in share.items() if x > most * have[s]}
        if not full:
            out.update(share)
            break
        for s in full:
            out[s] = most * have[s]
        left -= sum(out[s] for s, _ in ordered if s in full)
        free -= full
    return out


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from a digest of the parts."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), *[x.cast("string") for x in parts]), 256), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _pair(state: Column, x: Column) -> Column:
    """One pairing: words move at random between the carried row and ``x`` until one of them is whole.

    Either way the expected copies of both rows stay as they were, and the words of both together
    stay exactly as they were."""
    row, p, q = state["carry"]["row"], state["carry"]["p"], x["p"]
    a, b = row["size"], x["row"]["size"]
    to_carry, to_next = F.least((1.0 - p) * a, q * b), F.least(p * a, (1.0 - q) * b)
    gains = x["u"] * (to_carry + to_next) < to_next
    carry_settles = F.when(gains, (1.0 - p) * a <= q * b).otherwise(p * a <= (1.0 - q) * b)
    rest = F.when(gains, F.when(carry_settles, q - (1.0 - p) * a / b).otherwise(p + q * b / a)) \
        .otherwise(F.when(carry_settles, q + p * a / b).otherwise(p - (1.0 - q) * b / a))
    copies = F.when(gains == carry_settles, 1).otherwise(0)
    return F.struct(
        F.struct(F.when(carry_settles, x["row"]).otherwise(row).alias("row"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), rest)).alias("p"), x["u"].alias("u")).alias("carry"),
        F.concat(state["done"], F.array(F.struct(F.when(carry_settles, row).otherwise(x["row"]).alias("row"), copies.alias("copies")))).alias("done"),
    )


def _settle(state: Column, x: Column) -> Column:
    """The last rows of a source, longest first: each gets the words that the ones before it could not
    place, is rounded, and hands on what is left over."""
    due, size = state["due"] + x["p"] * x["row"]["size"], x["row"]["size"]
    copies = F.when(x["u"] * size < due, 1).otherwise(0)
    return F.struct((due - copies * size).alias("due"), F.concat(state["done"], F.array(F.struct(x["row"].alias("row"), copies.alias("copies")))).alias("done"))


def _fold(items: Column, done_type: str) -> Column:
    """Fold an array of (row, p, u) into settled rows and the one row that carries the rest."""
    start = F.struct(items[0].alias("carry"), F.expr(f"cast(array() as {done_type})").alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, _pair)


def pivotal_copies(rows: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(source, key, size, occ, copies) for rows (source, key, size, occ, p) with p in [0, 1).

    Blocks hold about ``block`` rows of one source and of like size, spread by digest, so no source
    however large meets in one task before it has shrunk by that factor at each level.
    """
    spark = rows.sparkSession
    row_type = "struct<key:bigint,size:bigint,occ:int>"
    done_type = f"array<struct<row:{row_type},copies:int>>"
    level = rows.select("source", F.struct("key", "size", "occ").alias("row"), "p")
    # rows of nearly equal size stand in one class: eight classes for each doubling of the size
    size_class = F.floor(F.log2(F.col("row.size").cast("double") + 1.0) * 8).cast("int")
    settled, depth, last = [], 0, False
    while not last:
        counts = {(r.source, r.cls): r.n for r in level.groupBy("source", size_class.alias("cls")).agg(F.count("*").alias("n")).collect()}
        # once every class is down to one row, a source's classes (a few hundred at most) meet in one block
        last = all(n == 1 for n in counts.values())
        u = _uniform(seed + depth, F.col("row.key"), F.col("row.occ"), F.col("row.size"))
        item = F.struct(F.col("row.size").alias("s"), "row", "p", u.alias("u"))
        if last:
            placed = level.select("source", F.lit(0).alias("cls"), F.lit(0).cast("long").alias("blk"), item.alias("item"))
        else:
            blocks = spark.createDataFrame([(s, c, -(-n // block)) for (s, c), n in counts.items()], "b_source string, b_cls int, blocks long")
            place = F.pmod(F.xxhash64(F.lit(seed + depth), "row.key", "row.occ"), F.col("blocks"))
            placed = level.withColumn("cls", size_class).join(blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("cls") == F.col("b_cls"))) \
                .select("source", "cls", place.alias("blk"), item.alias("item"))
        gathered = placed.groupBy("source", "cls", "blk").agg(F.sort_array(F.collect_list("item")).alias("items"))
        items = F.transform("items", lambda x: F.struct(x["row"].alias("row"), x["p"].alias("p"), x["u"].alias("u")))
        if last:
            start = F.struct(F.lit(0.0).alias("due"), F.expr(f"cast(array() as {done_type})").alias("done"))
            folded = gathered.select("source", F.aggregate(F.reverse(items), start, _settle).alias("f"))
        else:
            folded = written(gathered.select("source", _fold(items, done_type).alias("f")), "mix-level")
            level = folded.select("source", "f.carry.row", "f.carry.p")
        settled.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.row", "d.copies"))
        depth += 1
    out = settled[0]
    for done in settled[1:]:
        out = out.unionByName(done)
    return out.select("source", "row.key", "row.size", "row.occ", "copies")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 7,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(key, size, occ, source, source_size, target, copies) of every row, dropped ones with 0 copies."""
    sized = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("key"), size_of(F.col(text_col)).alias("size"))
    sized = written(sized, "mix-sizes")
    per_source = [(r.source, r.words) for r in sized.groupBy("source").agg(F.sum("size").alias("words")).collect()]
    goal = targets(per_source, weights, most)
    schema = "source string, source_size long, target double"
    plan = docs.sparkSession.createDataFrame([(s, n, goal[s]) for s, n in per_source], schema)
    # identical (id, size) rows of a source are numbered; with unique ids every number is 1
    same = Window.partitionBy("source", "key", "size").orderBy(F.lit(0))
    numbered = sized.withColumn("occ", F.row_number().over(same))
    rows = numbered.join(plan, numbered["source"].eqNullSafe(plan["source"])).select(
        numbered["source"], "key", "size", "occ", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    rows = rows.withColumn("whole", F.floor(F.least("rate", F.lit(most)) + 1e-12).cast("int"))
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    fractional = rows.filter("p > 1e-12 AND size > 0").select("source", "key", "size", "occ", "p")
    extra = pivotal_copies(fractional, seed)
    joined = rows.alias("r").join(
        extra.alias("e"),
        F.col("r.source").eqNullSafe(F.col("e.source")) & F.col("r.key").eqNullSafe(F.col("e.key")) & (F.col("r.size") == F.col("e.size")) & (F.col("r.occ") == F.col("e.occ")),
        "left")
    return joined.select("r.key", "r.size", "r.occ", "r.source", "r.source_size", "r.target", (F.col("whole") + F.coalesce("copies", F.lit(0))).alias("copies"))


def mixed_rows(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix with all columns of ``docs``: each as often as it is taken."""
    copies = mix_sources(docs, weights, most, seed, id_col, text_col, source_col).filter("copies > 0")
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    own_text = f"_c{docs.columns.index(text_col)}"
    named = docs.select(F.col(source_col).cast("string").alias("_source"), F.col(id_col).cast("long").alias("_key"), size_of(F.col(text_col)).alias("_size"), *own)
    # dealt out once, by what the copies are found with; only rows of one id, source and size are numbered among each other
    found_by = lambda key, source, size: F.xxhash64(F.col(key), F.col(source), F.col(size))
    named = named.withColumn("_id", found_by("_key", "_source", "_size")).repartition("_id")
    named = named.withColumn("_occ", F.row_number().over(Window.partitionBy("_id", "_key", "_source", "_size").orderBy(F.xxhash64(own_text))))
    copies = copies.withColumn("_found_by", found_by("key", "source", "size"))
    met = named.join(
        copies,
        (F.col("_id") == F.col("_found_by")) & F.col("_key").eqNullSafe(F.col("key")) & F.col("_source").eqNullSafe(F.col("source"))
        & (F.col("_size") == F.col("size")) & (F.col("_occ") == F.col("occ")))
    taken = met.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
