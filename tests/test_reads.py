"""The read analysis: SQL counterparts at the smallest scale, landmarks, fingerprints of parameters, exports."""

import glob
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayloom.config import build_config
from assayloom.constants import QC2
from assayloom.functions.order import natural_key
from assayloom.functions.sequences import CODONS, align_windows, find_motif, scan_landmark, translate
from assayloom.queries import ORACLE_SQL, QUERIES
from assayloom.source_queries import QUERIES as SOURCE_QUERIES
from assayloom.verdict_queries import QUERIES as VERDICT_QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    show = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([tuple(map(show, r)) for r in frame[columns].astype(object).itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", ["synthetic_reads", "read_names", "orientation", "quality_trim", "motif_positions", "insert_distances", "translation", "cdr3_lengths", "call_rows", "family_tally", "family_species", "panel_coverage", "batch_families", "control_verdicts", "insert_fingerprints", "csv_export", "primer_pairs", "primer_groups", "trace_mixing", "natural_order"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_fingerprints_of_defaults():
    cfg = build_config()
    assert (cfg.param_hash, cfg.errors, cfg.nondefault) == ("02d061d8", (), [])
    assert build_config({"insert_min": 900}).errors


@pytest.mark.parametrize("seq,sub,gap", [(QC2, 0, 0), (QC2[:12] + QC2[13:], 0, 1), (QC2[:12] + QC2[14:], 0, 2), (QC2[:12] + QC2[15:], 0, 3)])
def test_landmark_alignment(seq, sub, gap):
    got = align_windows(QC2, ["T" * 12 + seq + "A" * 12])[0]
    assert tuple(got[:2]) == (sub, gap)


def test_landmark_scan_is_leftmost():
    assert scan_landmark(QC2, "T" * 20 + QC2 + "A" * 5 + QC2) == (0, 20)
    assert scan_landmark(QC2, "ACGT") == (len(QC2), -1)


def test_motif_rules(spark):
    m, pad = "ACGTACGT", "T" * 12
    cases = [(pad + m, 60, 0, 12), (pad + "ACGTACGA", 5, 0, 12), (pad + "ACGTACCA", 5, 0, 12), (pad + "ACGTAGCA", 5, 0, -1), (pad + "ACGTACGA", 50, 0, -1), (pad + "ACGTACGA" + pad + m, 5, 0, 32), (m + pad, 60, 4, -1)]
    data = [(i, s, [q] * len(s), start) for i, (s, q, start, _) in enumerate(cases)]
    x = spark.createDataFrame(data, "i int, s string, q array<int>, start int")
    got = x.select("i", find_motif(F.col("s"), F.col("q"), m, F.col("start"), 2, 20)["pos"].alias("pos")).orderBy("i").collect()
    assert [r.pos for r in got] == [c[3] for c in cases]


def test_translation_of_codons(spark):
    assert len(CODONS) == 3375 and CODONS["RAY"] == "B" and CODONS["NNN"] == "X"
    got = spark.createDataFrame([("ATGTAAGGN?",), ("AT",), ("",)], "s string").select(translate(F.col("s")).alias("p")).collect()
    assert [r.p for r in got] == ["M*G", "", ""]


def test_natural_order(spark):
    names = [("c10",), ("c2",), ("C1",), ("1a",), ("vec",), ("a10b1",), ("a1b10",), ("a1b2",)]
    got = spark.createDataFrame(names, "n string").orderBy(natural_key(F.col("n"))).collect()
    assert [r.n for r in got] == ["1a", "a1b2", "a1b10", "a10b1", "C1", "c2", "c10", "vec"]


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(QUERIES) >= 30


def _fresh(code):
    """What a new process prints that has no session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


def test_entry_is_imported_without_a_session():
    assert int(_fresh("import __spark_entry__ as e; print(len(e.queries()))")[-1]) >= 30


@pytest.mark.parametrize("gone", ["corpus_pipeline assayloom.llm", "zstandard", "public_tokenizers"])
def test_entry_is_imported_without_the_corpus_operators(gone):
    """Their folder, or a library that they alone need, is missing: every other query is there."""
    hide = f"""
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if any(name == x or name.startswith(x + ".") for x in "{gone}".split()):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(sum(q.startswith("op") or q == "pipeline" for q in e.queries()), len(e.queries()))
"""
    assert [int(x) for x in _fresh(hide)[-2:]] == [0, len(QUERIES) + len(SOURCE_QUERIES) + len(VERDICT_QUERIES)]


def test_entry_does_not_hide_what_the_rest_lacks():
    hide = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "assayloom.sinks.scratch":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
try:
    import __spark_entry__
except ModuleNotFoundError as e:
    print(e.name)
"""
    assert _fresh(hide) == ["assayloom.sinks.scratch"]
