"""Medians and contained patterns against brute force, with ties, nulls, hot groups and empty tables."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from assayloom.constants import IUPAC
from assayloom.operators.containment import containment_pairs
from assayloom.operators.order_statistics import exact_medians

RNG = random.Random(7)


@pytest.mark.parametrize("bins", [7, 4096])
def test_medians(spark, bins):
    rows = [("hot", RNG.randrange(-(10**6), 10**6)) for _ in range(600)] + [("tie", 5)] * 9 + [("two", 1), ("two", 4), ("one", -3), ("none", None), (None, 8), (None, 9), (None, None)]
    rows += [("wide", 2**60), ("wide", -(2**60)), ("wide", 0), ("even", 10), ("even", 11), ("even", 11), ("even", 40)]
    got = {r.g: (r.n, r.least, r.most, r.median) for r in exact_medians(spark.createDataFrame(rows, "g string, v long"), ["g"], F.col("v"), bins).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = [x for k, x in rows if k == g and x is not None]
        want[g] = (len(v), min(v), max(v), float(statistics.median(v))) if v else (0, None, None, None)
    assert got == want


def test_medians_without_rows_or_keys(spark):
    empty = spark.createDataFrame([], "g string, v long")
    assert exact_medians(empty, ["g"], F.col("v")).count() == 0 and exact_medians(empty, [], F.col("v")).count() == 0
    whole = spark.range(1, 101).withColumn("median", F.lit("clashing"))
    assert [r.median for r in exact_medians(whole, [], F.col("id")).collect()] == [50.5]


def allowed(pattern):
    return [set(IUPAC[c]) for c in pattern]


@pytest.mark.parametrize("window", [1, 3, 6])
def test_contained_patterns(spark, window):
    letters, core = "ACGT" * 3 + "RYSWKMBDHVN", "CAGGTGCAGCTG"
    rows = [(i, RNG.choice("xy"), core[:6] + "".join(RNG.choice(letters) if RNG.random() < 0.3 else c for c in core[6:] + "AC"[: i % 3])) for i in range(80)]
    rows += [(100, "x", core), (101, "x", core), (101, "x", core), (102, "x", "N" * 12), (102, "x", core), (103, "z", "N"), (104, "z", "A"), (105, "z", ""), (106, "z", None), (107, None, "A"), (None, "z", "A"), (108, "x", "CAG-TGCAGCTG"), (109, "z", "n")]
    usable = {(i, g, p.upper()) for i, g, p in rows if i is not None and g and p and all(c in IUPAC for c in p.upper())}
    want = sorted(
        (g, a, b, min(len(p), len(q))) for (a, g, p), (b, h, q) in itertools.product(usable, usable) if g == h and a != b and all(y <= x for x, y in zip(allowed(p), allowed(q), strict=False))
    )
    got = containment_pairs(spark.createDataFrame(rows, "pid long, grp string, pattern string"), window)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_no_patterns(spark):
    assert containment_pairs(spark.createDataFrame([], "pid long, grp string, pattern string")).count() == 0
