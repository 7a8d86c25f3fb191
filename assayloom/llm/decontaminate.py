"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact weighted verification.

DataFrame functions only; nothing leaves the JVM.
"""

from __future__ import annotations

import functools
import itertools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHINGLE = 5
#: The fingerprint's 64 bits are indexed as 4 blocks of 16 bits.
BLOCKS, WIDTH = 4, 16
#: Two fingerprints within this many bits agree in some block but for FLIPS bits: 15 = 4 * (3 + 1) - 1.
FLIPS = 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Items with fewer shingles are met by a shared one: the fingerprint of so few is too coarse, and their windows are short.
SHORT = 8
#: Benchmark shingles that are broadcast at once (16 bytes each); more of them take turns.
MOST_SHINGLES = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for a null text."""
    return F.coalesce(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), F.array().cast("array<string>"))


def shingles_of(words: Column, size: int) -> Column:
    """The hashes of all runs of `size` words, in order, repeats included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    if size == 1:
        return hashes
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))
    # the word hashes are bound once to a variable of the lambda, not computed at every place
    runs = F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= size, each(h)).otherwise(F.array().cast("array<bigint>")))
    return F.get(runs, 0)


def fingerprints(sets: DataFrame, keys: list[str], shingles: str, most: int) -> DataFrame:
    """keys and the 64-bit SimHash of the multiset in `shingles`, which has `most` elements at most: each occurrence weighs one.

    Votes of several bits are summed in one long, in lanes wide enough for `most`.
    """
    lane = 16 if most < 1 << 16 else 32
    ones = sum(1 << k for k in range(0, 64, lane))
    vote = lambda j: F.shiftrightunsigned("h", j).bitwiseAND(F.lit(ones))
    sums = sets.select(*keys, F.explode(shingles).alias("h")).groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(vote(j)).alias(f"v{j}") for j in range(lane)])
    votes = lambda b: F.shiftrightunsigned(f"v{b % lane}", b // lane * lane).bitwiseAND(F.lit((1 << lane) - 1))
    parts = [F.shiftleft(F.when(2 * votes(b) > F.col("n"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"), b) for b in range(64)]
    return sums.select(*keys, functools.reduce(lambda a, b: a.bitwiseOR(b), parts).alias("fp"))


def block_values(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(j).alias("block"), F.shiftrightunsigned(fp, j * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).alias("value")) for j in range(BLOCKS)])


def near_values() -> Column:
    """Every change of at most FLIPS bits of a block, as a mask."""
    masks = [functools.reduce(operator.or_, (1 << b for b in bits), 0) for k in range(FLIPS + 1) for bits in itertools.combinations(range(WIDTH), k)]
    return F.array(*[F.lit(m).cast("bigint") for m in masks])


def benchmark_hits(documents: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, text_hash, item_id, similarity): documents with a window as long as the item that is similar to it.

    Texts are lower-case runs of letters and digits. A window has as many words as the item, or
    fewer at the end of the text; similarity is that of 5-word shingles, weighted by how often
    each occurs: sum of the lesser over sum of the greater counts, and percent / 100 at least
    counts. Items of fewer than five words are one shingle of all their words.

    Windows without a shingle of the item have similarity 0, and moving a window on to its first
    shared shingle loses none, so only windows that begin with a shingle of some item of that size
    are looked at. Those of items with fewer than SHORT shingles meet every item with which they
    share one, so none of these is lost; the others are fingerprinted. At exactly 0.8 fingerprints differ in 9.7 of 64 bits on average (standard
    deviation 2.9), at 0.9 in 6.6; the block index returns all within 15, which 4 * 697 of 65,536
    unrelated pairs meet, and the exact similarity decides. Equal windows of many documents are
    one row from there on, so a passage in a third of all rows costs no more.

    Null and empty texts have no hit; rows that repeat an id and a text give one row. Null item
    ids and empty items are left out; items that repeat an id are each looked for. Only the named
    columns are read, so others may have any name.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words")).where("item is not null and size(words) > 0")
    items = materialize(items.withColumn("run", F.least(F.size("words"), F.lit(SHINGLE))))
    out = []
    for run in sorted(r.run for r in items.select("run").distinct().collect()):  # 1 to 5 at most
        some = items.where(F.col("run") == run).select("item", shingles_of(F.col("words"), run).alias("shingles"))
        some = materialize(some.withColumn("size", F.size("shingles")))
        starts = some.select("size", F.explode("shingles").alias("h")).distinct()
        many, most = some.agg(F.sum("size"), F.max("size")).first()
        turns = max(1, -(-many // MOST_SHINGLES))
        rows = docs.select("id", "text_hash", shingles_of(F.col("words"), run).alias("shingles"))
        # the outer form: the inner one makes Spark filter by the size of shingles, which hashes every text again
        places = rows.select("id", "text_hash", "shingles", F.posexplode_outer("shingles").alias("pos", "h"))
        found = []
        for turn in range(turns):
            part = starts.where(F.pmod("h", F.lit(turns)) == turn)
            met = places.join(F.broadcast(part), "h").select("id", "text_hash", "size", F.expr("slice(shingles, pos + 1, size)").alias("window"))
            found.append(met)
        windows = functools.reduce(DataFrame.unionByName, found).withColumn("w", F.xxhash64("window"))
        # a window that lacks too many shingles at the end of the text can't be similar
        windows = windows.where(100 * F.size("window") >= percent * F.col("size"))
        windows = materialize(windows)
        distinct = materialize(windows.groupBy("size", "w").agg(F.first("window").alias("window")))
        long, short = F.col("size") >= SHORT, F.col("size") < SHORT
        marks = fingerprints(distinct.where(long), ["size", "w"], "window", most).select("size", "w", "fp", F.inline(block_values(F.col("fp"))))
        index = fingerprints(some.where(long), ["item", "size"], "shingles", most).select("item", "size", F.col("fp").alias("item_fp"), F.inline(block_values(F.col("fp"))))
        index = index.withColumn("mask", F.explode(near_values())).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask")
        # the index is larger than Spark takes it for and grows with the benchmark, so it is never broadcast
        close = marks.join(index.hint("merge"), ["size", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("size", "w", "item")
        few = distinct.where(short).select("size", "w", F.explode("window").alias("h")).join(some.where(short).select("item", "size", F.explode("shingles").alias("h")), ["size", "h"]).select("size", "w", "item")
        pairs = materialize(close.union(few).distinct())
        counts = lambda t, keys, col: t.select(*keys, F.explode(col).alias("h")).groupBy(*keys, "h").agg(F.count("*").alias("c"))
        mine = counts(distinct.join(pairs.select("size", "w").distinct(), ["size", "w"], "left_semi"), ["size", "w"], "window")
        theirs = counts(some, ["item", "size"], "shingles").withColumnRenamed("c", "d")
        shared = pairs.join(mine, ["size", "w"]).join(theirs, ["item", "size", "h"]).groupBy("size", "w", "item").agg(F.sum(F.least("c", "d")).alias("both"))
        exact = shared.join(distinct.select("size", "w", F.size("window").alias("n")), ["size", "w"])
        exact = exact.where(100 * F.col("both") >= percent * (F.col("n") + F.col("size") - F.col("both")))
        exact = exact.select("size", "w", "item", (F.col("both") / (F.col("n") + F.col("size") - F.col("both"))).alias("similarity"))
        out.append(windows.select("id", "text_hash", "size", "w").distinct().join(exact, ["size", "w"]).groupBy("id", "text_hash", "item").agg(F.max("similarity").alias("similarity")))
    if not out:
        return documents.select(F.col(id_col).alias("id"), F.lit(0).cast("bigint").alias("text_hash"), F.lit(None).cast("bigint").alias("item_id"), F.lit(0.0).alias("similarity")).where("false")
    return materialize(functools.reduce(DataFrame.unionByName, out).withColumnRenamed("item", "item_id"))


def contamination(documents: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, contaminated, n_items, best_similarity) for every row; 0 items and similarity 0 for clean, null and empty texts."""
    hits = benchmark_hits(documents, benchmark, percent, id_col, text_col)
    hits = hits.groupBy("id", "text_hash").agg(F.count("*").alias("n_items"), F.max("similarity").alias("best"))
    rows = documents.select(F.col(id_col).alias("own"), F.xxhash64(text_col).alias("own_hash"))
    met = rows.join(hits, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    return met.select(F.col("own").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("best", F.lit(0.0)).alias("best_similarity"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents, all columns, that hold no benchmark item; repeats of a clean row stay, extra columns may have any name."""
    name = _free(documents, "hit")
    hits = benchmark_hits(documents, benchmark, percent, id_col, text_col).select(F.struct("id", "text_hash").alias(name)).distinct()
    same = F.col(f"{name}.id").eqNullSafe(documents[id_col]) & (F.xxhash64(documents[text_col]) == F.col(f"{name}.text_hash"))
    return documents.join(hits, same, "left_anti")


def _free(documents: DataFrame, name: str) -> str:
    """A column name that documents lacks."""
    while name.lower() in (c.lower() for c in documents.columns):
        name = f"_{name}"
    return name
