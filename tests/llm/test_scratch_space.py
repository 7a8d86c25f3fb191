"""What operators leave on disk while and after they work."""

from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayloom.llm import ngram_join
from assayloom.llm.katz import _weigh, katz_scores, pack, pack_sorted
from assayloom.llm.ngram_join import jaccard_components, parities, possible_links
from assayloom.sinks.scratch import discard, materialize, scratch_root

RNG = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(400)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, " ".join(RNG.choice(WORDS, 60))) for i in range(60)], "doc_id long, text string")


def folders(spark):
    root = Path(urlparse(scratch_root(spark)).path)
    return {x for x in root.iterdir() if x.is_dir()} if root.is_dir() else set()


def test_katz_leaves_neither_blocks_nor_totals(spark, texts):
    before = folders(spark)
    scores = katz_scores(texts, F.col("doc_id") % 10 != 0)
    left = [set(spark.read.parquet(str(x)).columns) for x in folders(spark) - before]
    assert left and not any({"words", "grams", "own"} & columns for columns in left)
    assert scores.where("score < 0").count() == 60  # what is left is enough


def test_context_sums_by_plain_loops():
    contexts = [np.unique(RNG.integers(0, 50, 30)).astype(np.uint64) << np.uint64(50) for _ in range(4)]
    total = {int(c): int(RNG.integers(1, 9)) for x in contexts for c in x}
    taken, lower = ([RNG.random(len(x)) / 9 for x in contexts] for _ in range(2))
    rows = {"contexts": map(pack_sorted, contexts), "taken": map(pack, taken), "lower": map(pack, lower), "total": (pack(np.array([total[int(c)] for c in x])) for x in contexts)}
    got = _weigh((pa.scalar(2), pa.scalar(0)), pa.table({c: pa.array(list(x), pa.binary()) for c, x in rows.items()})).to_pylist()
    assert sorted(r["context"] for r in got) == sorted(total) and {r["m"] for r in got} == {2}
    for r in got:
        a, b = (sum(x[contexts[k] == r["context"]].sum() for k, x in enumerate(xs)) for xs in (taken, lower))
        assert np.isclose(r["weight"], (1 - a / total[r["context"]]) / (1 - b), rtol=1e-12)


def test_only_scratch_tables_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/kept")
    kept, one, two = spark.read.parquet(f"{tmp_path}/kept"), materialize(spark.range(3)), materialize(spark.range(4))
    with pytest.raises(ValueError):
        discard(kept)
    before = folders(spark)
    discard(one.union(two))
    assert kept.count() == 3 and len(before - folders(spark)) == 2


def test_parities_lose_no_link_and_part_others(spark):
    rows, pairs, near = [], [], []
    for k in range(300):
        n = int(RNG.integers(1, 900))
        x = RNG.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate([x[int(RNG.integers(0, n // 15 + 1)) :], RNG.integers(0, 1 << 63, int(RNG.integers(0, n // 15 + 1))).astype(np.uint64)])
        z = np.concatenate([x[: n // 2], RNG.integers(0, 1 << 63, n - n // 2).astype(np.uint64)])
        rows += [(4 * k + i, len(s), parities(s).tolist()) for i, s in enumerate((x, y, z))]
        pairs += [(4 * k, 4 * k + 1), (4 * k, 4 * k + 2)]
        same = len(np.intersect1d(x, y))
        near += [(4 * k, 4 * k + 1)] if 100 * same >= 90 * (len(x) + len(y) - same) else []
    got = {tuple(r) for r in possible_links(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "id long, n long, parity array<long>"), 90).collect()}
    assert len(near) > 100 and got >= set(near)
    assert sum(b % 4 == 2 for _, b in got) < 15  # half of their shingles differ


def test_only_texts_that_may_link_are_shuffled(spark, monkeypatch):
    """Texts of one common passage meet by it, but only the near copies among them are sent on."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"u{i}x{j}" for j in range(30))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(3)]
    sent = []

    def watch(df, *codec):
        out = materialize(df, *codec)
        if df.columns == ["id", "packed"]:
            sent.extend(r.id for r in out.select("id").collect())
        return out

    monkeypatch.setattr(ngram_join, "materialize", watch)
    monkeypatch.setattr(ngram_join, "shingle_sketch", lambda texts, words_each, bits: np.zeros(1 << bits, np.int64))  # nothing is known to be common
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in rows}
    assert set(sent) == {0, 1, 2, 100, 101, 102}


def test_shuffles_of_finished_steps_are_deleted(spark, texts, monkeypatch):
    seen, name = [], "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    monkeypatch.setattr(ngram_join, "materialize", lambda df, *codec: (seen.append(spark.conf.get(name)), materialize(df, *codec))[1])
    jaccard_components(texts)
    assert seen and set(seen) == {"true"} and spark.conf.get(name) == before
