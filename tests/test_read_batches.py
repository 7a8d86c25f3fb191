"""Whole-batch functions of reads against plain loops, and reports whose lists are as long as the batch."""

import random

import numpy as np
from pyspark.sql import functions as F

from assayloom.constants import LIBRARY, QC2, REPEAT_MAX_PERIOD
from assayloom.fixtures import fx_reads, primer_fasta
from assayloom.functions.order import natural_key, natural_text
from assayloom.functions.sequences import _runs, align_windows, is_reversed, reverse_complement
from assayloom.operators import composition as C
from assayloom.operators import reports
from assayloom.plans.analysis import analyze
from assayloom.sources.fasta import read_primers


def test_tandem_runs_by_words():
    rnd = random.Random(3)
    for _ in range(60):
        unit = "".join(rnd.choice("ACG") for _ in range(rnd.randint(9, 62)))
        text = "".join(rnd.choice("ACG") for _ in range(rnd.randint(0, 60))) + unit * rnd.randint(1, 3) + "A" * rnd.randint(0, 40)
        letters = np.frombuffer(text.encode(), np.uint8)
        words = np.lib.stride_tricks.sliding_window_view(letters, 8).copy().view(np.uint64)[:, 0]
        for period in range(9, REPEAT_MAX_PERIOD + 1):
            want = [i for i in range(len(text) - 2 * period + 1) if text[i : i + period] == text[i + period : i + 2 * period]]
            assert _runs(letters, words, period).tolist() == want


def test_alignment_of_several_chunks_of_windows():
    rnd = random.Random(4)
    windows = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 9))) + QC2[: rnd.randint(0, 40)] + QC2[rnd.randint(30, 44) :] for _ in range(300)]
    assert (align_windows(QC2, windows) == np.concatenate([align_windows(QC2, [w]) for w in windows])).all()


def test_anchors_are_turned_instead_of_reads(spark):
    x = spark.createDataFrame([("A" * 9 + QC2 + "C" * 9,), ("NNRY",), (None,)], "s string")
    x = x.union(x.select(reverse_complement(F.col("s"))))
    assert [r[0] for r in x.select(is_reversed(F.col("s"))).collect()] == [False, False, None, True, False, None]
    assert "translate" not in x.select(is_reversed(F.col("s")).alias("b"))._jdf.queryExecution().optimizedPlan().toString().split("Project")[1]


def test_natural_text_has_the_order_of_parts(spark):
    names = ["a", "A1", "a01", "a1b", "a10", "a9", "", "7", "07x", "a\x00", "a\x00b", "a\x005", "ab", "é2", "a" + "9" * 40, None, "a-1", "a1-"]
    x = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    by = lambda key: [r.i for r in x.orderBy(key(F.col("n")), "i").collect()]
    assert by(natural_text) == by(natural_key)


def test_long_lists_are_joined_in_stretches(spark):
    x = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("ord"), F.when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("id")).repartition(5)
    want = [r.id for r in sorted(x.collect(), key=lambda r: r.ord)]
    assert [(r.n, r.text) for r in reports.listed(x, ["ord"], "id").collect()] == [(20000, ", ".join(t for t in want if t is not None))]
    assert [(r.n, r.text) for r in reports.listed(x.where("false"), ["ord"], "id").collect()] == [(0, "")]


def test_reports_with_and_without_repeated_ids(spark):
    reads = fx_reads(spark, "/root/testdata/sf0.001").where("ord < 60")
    for again in (False, True):
        some = reads.withColumn("id", F.when(F.col("ord") % 20 == 3, "VH9").otherwise(F.col("id"))) if again else reads
        run = analyze(some, read_primers(spark, primer_fasta()), {"analysis_mode": LIBRARY}, "batch")
        assert run.ids_repeat() == again
        by_join = reports.summary(run.qc, run.calls, run.config, "batch")
        assert sorted(map(str, run.summary.collect())) == sorted(map(str, by_join.collect()))
    facts = C.compose_facts(run.calls, run.config).first()
    assert "cdr3_lens" not in facts and len(facts.cdr3_sizes) == len({x.cdr3_len for x in facts.cdr3_sizes}) and sum(x.n for x in facts.cdr3_sizes) <= facts.n_good
