"""Benchmark items of few words, and the recall of the fingerprints by item size."""

from collections import Counter

import numpy as np
import pytest

from assayloom.llm.decontaminate import RADIUS, SHORT, benchmark_hits, fingerprints


def similar(text, item):
    """The greatest weighted Jaccard of the item with any window of the text as long as it, or shorter at the end."""
    run = min(5, len(item))
    grams = lambda w: [tuple(w[i : i + run]) for i in range(len(w) - run + 1)]
    have, want = grams(text), grams(item)
    best = (0, 1)
    for i in range(len(have)):
        window = Counter(have[i : i + len(want)])
        both = sum((window & Counter(want)).values())
        best = max(best, (both, window.total() + len(want) - both), key=lambda x: x[0] / x[1])
    return best


def test_items_of_one_to_twelve_words(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 400)}"
    items = [(n * 10 + k, [word() for _ in range(n)]) for n in range(1, 13) for k in range(3)]
    docs = []
    for i in range(150):
        item = list(items[i % len(items)][1])
        if i % 3 == 1 and len(item) > 8:
            item[0 if i % 2 else -1] = "changed"
        docs.append((i, [word() for _ in range(i % 40)] + item + ([word() for _ in range(i % 7)] if i % 4 else [])))
    got = {(r.id, r.item_id): r.similarity for r in benchmark_hits(
        spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"),
    ).collect()}
    want = {}
    for i, text in docs:
        for j, item in items:
            both, all_ = similar(text, item)
            if 100 * both >= 80 * all_ and both:
                want[i, j] = both / all_
    exact = {k: v for k, v in want.items() if len(dict(items)[k[1]]) - 4 < SHORT}
    assert {k: v for k, v in got.items() if k in exact} == pytest.approx(exact)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)


def test_recall_of_fingerprints_by_size(spark):
    """Windows at similarity 0.8 to 0.86, those that lose shingles and those that swap them, for items of 8 to 40 shingles."""
    rng = np.random.default_rng(6)
    whole = lambda n: [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)]
    rows, pairs = [], {}
    for size in (8, 9, 10, 12, 15, 16, 20, 25, 30, 40):
        kinds = [(lost, extra) for lost in range(size) for extra in range(lost + 1) if 0.8 <= (size - lost) / (size + extra) <= 0.86]
        for lost, extra in kinds:
            for _ in range(150):
                item = whole(size)
                rows += [(len(rows), item), (len(rows) + 1, item[lost:] + whole(extra))]
                pairs.setdefault((size, lost, extra), []).append(len(rows) - 2)
    frame = spark.createDataFrame(rows, "k long, s array<long>")
    fp = {r.k: r.fp for r in fingerprints(frame, ["k"], "s", 40).collect()}
    wide = {r.k: r.fp for r in fingerprints(frame.where("k < 50"), ["k"], "s", 1 << 20).collect()}
    assert all(fp[k] == v for k, v in wide.items())
    for kind, firsts in pairs.items():
        assert np.mean([((fp[i] ^ fp[i + 1]) & (1 << 64) - 1).bit_count() <= RADIUS for i in firsts]) >= 0.9, kind
    by_size = {size: np.mean([((fp[i] ^ fp[i + 1]) & (1 << 64) - 1).bit_count() <= RADIUS for kind, f in pairs.items() if kind[0] == size for i in f]) for size, *_ in pairs}
    assert min(by_size.values()) >= 0.95, by_size
