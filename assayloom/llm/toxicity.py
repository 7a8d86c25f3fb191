"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP, Words, batches, bounded_batches, chain, labelled_sample, materialize, mix, string_hashes

#: Characters that are cut from both ends of a word.
EDGES = " .,;:!?¡¿()[]{}<>\"'`´“”„«»…*#&%$|_-–—/\\"
#: The sample's rows are dealt to so many tasks, each of which counts features in a table of 2 ** bits 16-bit numbers.
SHARES = 16
#: Lengths of stems in characters.
STEMS = (4, 6)


@dataclass(frozen=True)
class FtrlParameters:
    """bits: log2 of the feature space. rows: most labelled rows that are learnt from."""

    bits: int = 20
    rows: int = 20000
    epochs: int = 8
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    seed: int = 5


def feature_places(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every unigram, stem, bigram and one-gap skip-gram; repeats are kept.

    A stem is the first characters of a longer word, so that inflected forms share what they teach.
    """
    words = Words(texts)
    names = pc.utf8_trim(pc.utf8_lower(words.vocabulary), characters=EDGES)
    h = string_hashes(names)[words.ids]
    rows, feats = [words.doc], [mix(h + STEP)]
    letters = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    for size in STEMS:
        cut = string_hashes(pc.utf8_slice_codeunits(names, 0, size)) + np.uint64(size)
        longer = (letters > size)[words.ids]
        rows.append(words.doc[longer])
        feats.append(mix(cut)[words.ids][longer])
    for gap in (1, 2):
        if len(h) > gap:
            same = words.doc[:-gap] == words.doc[gap:]
            rows.append(words.doc[:-gap][same])
            feats.append(chain(h[:-gap] + np.uint64(gap), h[gap:])[same])
    return np.concatenate(rows), (np.concatenate(feats) >> np.uint64(64 - bits)).astype(np.int32)


def _train(part, p: FtrlParameters):
    """One task learns from the bounded sample; returns the coordinates that are not zero."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    zb = nb = 0.0
    rows = [(f, y) for batch in part for f, y in zip((np.asarray(x) for x in batch["features"].to_numpy(zero_copy_only=False)), batch["y"].to_numpy(), strict=True)]

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        return np.where(np.abs(z[i]) > p.l1, w, 0.0)

    for _ in range(p.epochs if rows else 0):
        for i, y in rows:
            w, b = weights(i), -zb * p.alpha / (p.beta + np.sqrt(nb))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha * w
            n[i] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha * b
            nb += g * g
    at = np.flatnonzero(np.abs(z) > p.l1)
    yield pa.RecordBatch.from_pydict({"feature": pa.array([-1, *at], pa.int32()), "weight": pa.array([-zb * p.alpha / (p.beta + np.sqrt(nb)), *weights(at)], pa.float64())})


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    bias: float
    features: np.ndarray
    weights: np.ndarray


def fit_toxicity(documents: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", parameters: FtrlParameters | None = None) -> ToxicityModel:
    """Learn from at most parameters.rows labelled documents; only their sorted feature numbers meet in one task.

    Features that are too rare in the sample to ever pass the L1 term are counted and left out
    first, which changes nothing and spares memory. The L1 term leaves few weights (2 ** bits at the
    very most), so the model is small enough for the driver and a broadcast. With no labelled row the bias is 0: every score is 0.5.
    """
    p = parameters or FtrlParameters()
    sample = labelled_sample(documents, labels, label, learn, p.rows, p.seed)

    def features(part):
        for batch in part:
            for at, size in batches(batch["text"]):
                rows, places = feature_places(batch["text"].slice(at, size), p.bits)
                order = np.argsort(rows, kind="stable")
                starts = np.searchsorted(rows[order], np.arange(size + 1))
                places = places[order]
                yield pa.RecordBatch.from_pydict(
                    {
                        "turn": batch["turn"].slice(at, size),
                        "doc_id": batch["doc_id"].slice(at, size),
                        "y": batch["y"].slice(at, size),
                        "features": pa.array([np.unique(places[a:b]) for a, b in zip(starts, starts[1:])], pa.list_(pa.int32())),
                    }
                )

    schema = "turn long, doc_id long, y int, features array<int>"
    texts = bounded_batches(sample).select("turn", F.col("doc_id").cast("long").alias("doc_id"), "y", "text")
    made = materialize(texts.mapInArrow(features, schema).repartition(SHARES, "turn"))

    def count(part):
        total = np.zeros(1 << p.bits, np.int32)
        for batch in part:
            total += np.bincount(batch["features"].flatten().to_numpy(), minlength=1 << p.bits).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())})

    # a row moves z by less than 1 an epoch while the weight is 0, so rarer features never pass l1
    seen = sum((np.frombuffer(x, np.uint16).astype(np.int32) for x in made.select("features").mapInArrow(count, "counts binary").toArrow()["counts"].to_pylist()), np.zeros(1 << p.bits, np.int32))
    often = documents.sparkSession.sparkContext.broadcast(seen * p.epochs > p.l1)

    def prune(part):
        for batch in part:
            lists = batch["features"]
            flat, keep = lists.flatten().to_numpy(), often.value[lists.flatten().to_numpy()]
            ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
            yield pa.RecordBatch.from_arrays([batch["turn"], batch["doc_id"], batch["y"], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[keep]))], batch.schema.names)

    got = made.mapInArrow(prune, schema).repartition(1).sortWithinPartitions("turn", "doc_id", "features").mapInArrow(lambda part: _train(part, p), "feature int, weight double").toArrow()
    f, w = got["feature"].to_numpy(), got["weight"].to_numpy()
    return ToxicityModel(p.bits, float(w[f < 0].sum()), f[f >= 0], w[f >= 0])


def score_toxicity(documents: DataFrame, model: ToxicityModel, score_col: str = "score") -> DataFrame:
    """All columns and rows of documents and score_col: the probability of the label, from the whole text.

    A feature counts once a text. Null and empty texts get the score of the bias alone. A column
    that is named score_col already is replaced; repeated rows are scored each.
    """
    documents = bounded_batches(documents.drop(score_col))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(part):
        m = shared.value
        dense = np.zeros(1 << m.bits, np.float32)
        dense[m.features] = m.weights
        for batch in part:
            for at, size in batches(batch["text"]):
                piece = batch.slice(at, size)
                rows, places = feature_places(piece["text"], m.bits)
                hit = dense[places] != 0
                seen = np.unique(rows[hit] * (1 << m.bits) + places[hit])
                total = np.bincount(seen >> m.bits, dense[seen & ((1 << m.bits) - 1)], size) + m.bias
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], [*piece.schema.names, score_col])

    return documents.mapInArrow(score, T.StructType([*documents.schema.fields, T.StructField(score_col, T.DoubleType())]))
