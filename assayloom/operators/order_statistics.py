"""Exact medians of whole numbers by group, from histograms that are refined until a bin is one number."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.scratch import materialize

#: Bins a group and rank are counted into in one pass.
BINS = 4096


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[k])
    return out


def exact_medians(rows: DataFrame, keys: list[str], value: Column, bins: int = BINS) -> DataFrame:
    """(keys, n, least, most, median) for each group: of how many numbers, and their exact median as a double.

    No group's values are gathered or sorted: each pass counts them into at most `bins` bins of the
    range that the wanted rank is known to lie in, combined before the shuffle, and keeps the bin of
    the rank. Values that differ by less than bins ** k take k passes over a narrow table (two for
    4,096 bins and a range below 16 million), whatever their number; only that range reaches the
    driver. A group that holds most of the rows is no larger after the partial counts than any other.

    Null values don't count; a group of nulls alone has n = 0 and nulls. Null keys are a group. An even
    number of values takes the mean of the two in the middle. Values are within -2 ** 61 and 2 ** 61;
    an empty table gives no rows (also without keys).
    """
    names = [f"k{i}" for i in range(len(keys))]
    narrow = materialize(rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], value.cast("long").alias("v")))
    ends = narrow.groupBy(*names).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("rows"))
    ends = materialize(ends.where("rows > 0").drop("rows"))
    width = ends.agg(F.max(F.col("most") - F.col("least"))).first()[0] or 0
    passes = max(1, math.ceil(math.log(width + 1, bins) - 1e-9)) if width else 0
    ranks = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))  # counted from 0
    state = ends.where("n > 0").select(*names, F.explode(ranks).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))
    state = state.withColumn("left", F.col("rank"))
    while passes and bins**passes <= width:  # the logarithm was rounded
        passes += 1
    for _ in range(passes):
        state = materialize(_refined(narrow, state, names, bins))
    middle = state.groupBy(*[F.col(n).alias(f"of_{n}") for n in names]).agg((F.sum("lo") / F.count("*")).alias("median"))
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"of_{n}")) for n in names], F.lit(True))
    return ends.join(middle, same, "left").select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "n", "least", "most", "median")


def _refined(narrow: DataFrame, state: DataFrame, names: list[str], bins: int) -> DataFrame:
    """state (names, rank, lo, hi, left), where the value of rank is the left-th from lo, with lo and hi drawn in to one bin."""
    step = F.expr(f"(hi - lo) div {bins} + 1")
    wanted = state.withColumn("step", step)
    held = narrow.join(wanted, _same(narrow, wanted, names)).where("v between lo and hi")
    held = held.select(*[wanted[n] for n in names], "rank", "lo", "hi", "left", "step", F.expr("(v - lo) div step").alias("bin"))
    counted = held.groupBy(*names, "rank", "lo", "hi", "left", "step", "bin").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*names, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most `bins` rows
    at = counted.withColumn("upto", F.sum("c").over(upto)).where("upto > left and upto - c <= left")
    lo = F.col("lo") + F.col("bin") * F.col("step")
    return at.select(*names, "rank", lo.alias("lo"), F.least(F.col("hi"), lo + F.col("step") - 1).alias("hi"), (F.col("left") - (F.col("upto") - F.col("c"))).alias("left"))
