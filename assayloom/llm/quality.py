"""Quality scores: naive Bayes support vectors over hashed n-grams of words and word shapes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP, Words, batches, bounded_batches, chain, labelled_sample, mix, string_hashes


@dataclass(frozen=True)
class NbSvmParameters:
    """bits: log2 of the feature space. rows: most labelled rows that are learnt from."""

    bits: int = 20
    rows: int = 20000
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 15
    seed: int = 9


def feature_sets(texts: pa.Array, bits: int) -> list[np.ndarray]:
    """The distinct feature numbers of each text.

    Features are word uni- and bigrams and the uni-, bi- and trigrams of word shapes. A shape is
    the word with each run of letters as `a` and of digits as `0`, whether its letters are
    capitals, and whether one of the two words before it is the same.
    """
    words = Words(texts, lower=False)
    v = words.vocabulary
    plain = string_hashes(pc.utf8_lower(v))[words.ids]
    shape = pc.replace_substring_regex(pc.replace_substring_regex(v, r"\p{N}+", "0"), r"[\p{L}\p{M}]+", "a")
    capitals = pc.and_(pc.utf8_is_upper(v), pc.greater(pc.utf8_length(v), 2)).to_numpy(zero_copy_only=False).astype(np.uint64)
    look = (string_hashes(shape) + capitals * STEP)[words.ids]
    doc, n = words.doc, len(plain)
    again = np.zeros(n, np.uint64)
    for gap in (1, 2):
        if n > gap:
            again[gap:] |= ((plain[gap:] == plain[:-gap]) & (doc[gap:] == doc[:-gap])).astype(np.uint64) << np.uint64(gap - 1)
    look = mix(look + again)
    rows, feats = [doc, doc], [mix(plain), mix(look + STEP)]
    if n > 1:
        same = doc[:-1] == doc[1:]
        rows += [doc[:-1][same]] * 2
        feats += [chain(plain[:-1], plain[1:])[same], chain(look[:-1] + STEP, look[1:])[same]]
    if n > 2:
        same = doc[:-2] == doc[2:]
        rows.append(doc[:-2][same])
        feats.append(chain(chain(look[:-2] + STEP, look[1:-1]), look[2:])[same])
    size = len(texts)
    key = np.concatenate(rows) << np.int64(bits) | (np.concatenate(feats) >> np.uint64(64 - bits)).astype(np.int64)
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    ends = np.searchsorted(key, np.arange(size + 1, dtype=np.int64) << np.int64(bits))
    key = (key & ((1 << bits) - 1)).astype(np.int32)
    return [key[a:b] for a, b in zip(ends, ends[1:])]


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, by Newton steps, with Platt's softened targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    if not up or not down:
        return 1.0, 0.0
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, ab = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (q - t))
        ab = ab - step
        if np.abs(step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


def _margins(sets, w, ratio, bias):
    return np.array([(w[i] @ ratio[i]) / max(np.linalg.norm(ratio[i]), 1e-12) + bias for i in sets])


def _descend(sets, y, ratio, size, p):
    """Dual coordinate descent for the hinge loss; rows are ratio-scaled indicators of unit length, plus a constant."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(sets))
    scale = np.array([1 / max(np.linalg.norm(ratio[i]), 1e-12) for i in sets])  # rows are scaled anew when their turn comes, which halves the memory
    squares = np.array([(ratio[i] @ ratio[i]) * f * f + 1 for i, f in zip(sets, scale, strict=True)])
    weight = np.where(y > 0, len(y) / 2 / max((y > 0).sum(), 1), len(y) / 2 / max((y <= 0).sum(), 1)) * p.cost
    order, rng = np.arange(len(sets)), np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        rng.shuffle(order)
        moved = 0.0
        for k in order:
            i = sets[k]
            x = ratio[i] * scale[k]
            gradient = y[k] * (w[i] @ x + bias) - 1
            new = min(max(alpha[k] - gradient / squares[k], 0.0), weight[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                w[i] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[k] = new
        if moved < 1e-3:
            break
    return w, bias


def _train(part, p: NbSvmParameters):
    """One task learns from the bounded sample; every fifth row calibrates the scores instead."""
    sets, y = [], []
    for batch in part:
        sets += [np.asarray(x) for x in batch["features"].to_numpy(zero_copy_only=False)]
        y += batch["y"].to_pylist()
    size, y = 1 << p.bits, np.array(y) * 2.0 - 1
    w, ratio, bias, slope, offset = np.zeros(size), np.zeros(size), 0.0, 1.0, 0.0
    if len(y):
        held = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
        own = np.flatnonzero(~held)
        counts = [np.full(size, p.smoothing), np.full(size, p.smoothing)]
        seen = np.zeros(size, bool)
        for k in own:
            counts[int(y[k] > 0)][sets[k]] += 1
            seen[sets[k]] = True
        ratio = np.where(seen, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()), 0.0).astype(np.float32)
        w, bias = _descend([sets[k] for k in own], y[own], ratio, size, p)
        rest = np.flatnonzero(held) if held.any() else own
        slope, offset = _platt(_margins([sets[k] for k in rest], w, ratio, bias), y[rest])
    at = np.flatnonzero((w != 0) | (ratio != 0))
    extra = [bias, slope, offset]
    yield pa.RecordBatch.from_pydict(
        {"feature": pa.array([-1, -2, -3, *at], pa.int32()), "weight": pa.array([*extra, *w[at]], pa.float32()), "ratio": pa.array([0.0, 0.0, 0.0, *ratio[at]], pa.float32())}
    )


@dataclass(frozen=True)
class QualityModel:
    """Three numbers and at most 2 ** bits weights and ratios."""

    bits: int
    bias: float
    slope: float
    offset: float
    features: np.ndarray
    weights: np.ndarray
    ratios: np.ndarray


def fit_quality(documents: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", parameters: NbSvmParameters | None = None) -> QualityModel:
    """Learn from at most parameters.rows labelled documents; only their feature numbers meet in one task.

    With no labelled row, or one class alone, there is nothing to tell apart: scores are 0.5, or
    follow the margin uncalibrated.
    """
    p = parameters or NbSvmParameters()
    sample = labelled_sample(documents, labels, label, learn, p.rows, p.seed)

    def features(part):
        for batch in part:
            for at, size in batches(batch["text"]):
                piece = batch.slice(at, size)
                yield pa.RecordBatch.from_pydict({"turn": piece["turn"], "doc_id": piece["doc_id"], "y": piece["y"], "features": pa.array(feature_sets(piece["text"], p.bits), pa.list_(pa.int32()))})

    made = bounded_batches(sample).select("turn", F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(features, "turn long, doc_id long, y int, features array<int>")
    got = made.repartition(1).sortWithinPartitions("turn", "doc_id", "features").mapInArrow(lambda part: _train(part, p), "feature int, weight float, ratio float").toArrow()
    f, w, r = (got[c].to_numpy() for c in ("feature", "weight", "ratio"))
    bias, slope, offset = (float(w[f == -k].sum()) for k in (1, 2, 3))
    return QualityModel(p.bits, bias, slope, offset, f[f >= 0], w[f >= 0], r[f >= 0])


def score_quality(documents: DataFrame, model: QualityModel, score_col: str = "score") -> DataFrame:
    """All columns and rows of documents and score_col: the calibrated probability of label 1, from the whole text.

    Null and empty texts have no feature; their margin is the constant alone. A column that is
    named score_col already is replaced; repeated rows are scored each.
    """
    documents = bounded_batches(documents.drop(score_col))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(part):
        m = shared.value
        w, ratio = np.zeros(1 << m.bits, np.float32), np.zeros(1 << m.bits, np.float32)
        w[m.features], ratio[m.features] = m.weights, m.ratios
        for batch in part:
            for at, size in batches(batch["text"]):
                piece = batch.slice(at, size)
                margin = _margins(feature_sets(piece["text"], m.bits), w, ratio, m.bias).astype(np.float64)
                result = 1 / (1 + np.exp(-np.clip(margin * m.slope + m.offset, -35, 35)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(result)], [*piece.schema.names, score_col])

    return documents.mapInArrow(score, T.StructType([*documents.schema.fields, T.StructField(score_col, T.DoubleType())]))
