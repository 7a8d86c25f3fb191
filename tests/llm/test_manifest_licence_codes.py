"""Merkle manifests, licence scans and vector codes: edge cases, and plain loops by the definitions."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.llm import merkle
from assayloom.llm.licences import LicenceTemplate, exact_phrase, licence_labels, licence_places
from assayloom.llm.merkle import PartialParents, digest_of, folded, merkle_manifest, proof_digest
from assayloom.llm.queries import BASE_PHRASES, NOTICES
from assayloom.llm.vector_codes import digest_codebooks, label_errors, largest_component, nearest_entries, product_codes

DOCS = "doc_id long, text string, lang string, tree_ string"
VECTORS = "vec_id long, embedding array<double>, label int"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves, arity):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def beside(levels, i, arity):
    out = []
    for row in levels[:-1]:
        run = i // arity * arity
        out += [d for k, d in enumerate(row[run : run + arity], run) if k != i]
        i //= arity
    return out


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_by_definition(spark, monkeypatch, arity):
    """Runs of 4 leaves and spans of 16, so that frontiers meet in several rounds; nulls, repeats, a lone leaf."""
    monkeypatch.setattr(merkle, "RUN_BITS", 2)
    monkeypatch.setattr(merkle, "SPAN_BITS", 2)
    rows = [(i * 7 % 97, f"text {i}", "de", "x") for i in range(97)] + [(i, None, None, "x") for i in range(5)]
    rows += [(None, "", "en", None), (None, "é" * 50_000, "en", None), (4, "same", "en", None), (4, "same", "en", None), (9, "alone", "", "x")]
    docs = spark.createDataFrame(rows, DOCS).select("*", digest_of([F.col(c) for c in ("doc_id", "lang", "text")]).alias("leaf"))
    got = merkle_manifest(docs, "lang", ["doc_id", "leaf"], "leaf", arity).select("*", proof_digest(F.col("way")).alias("p"), folded(F.col("leaf"), F.col("way")).alias("f")).collect()
    assert len(got) == len(rows)
    named = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = {}
    for doc_id, text, lang, _ in rows:
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, sha([named(doc_id), named(lang), named(text)])))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: levels_of([x[2] for x in sorted(trees[g])], arity) for g in order}
    top = levels_of([built[g][-1][0] for g in order], arity)
    want = sorted((leaf[2], built[g][-1][0], top[-1][0], sha(beside(built[g], i, arity) + beside(top, order.index(g), arity))) for g in order for i, leaf in enumerate(sorted(trees[g])))
    assert sorted((r.leaf, r.subroot, r.root, r.p) for r in got) == want
    assert all(r.f == r.root for r in got)
    assert merkle_manifest(docs.limit(0), "lang", ["doc_id", "leaf"], "leaf", arity).count() == 0


def test_parents_are_emitted_when_full():
    parents = PartialParents(5, 2)
    for i in (4, 1, 0):
        parents.add(0, i, str(i))
    assert [(level, i) for level, i, _ in parents.frontier()] == [(1, 0), (2, 1)]  # the lone last leaf went up twice
    for i in (2, 3):
        parents.add(0, i, str(i))
    assert parents.frontier() == [(3, 0, levels_of(list("01234"), 2)[-1][0])]
    assert PartialParents(1, 2).way(0, 0, {(0, 0): []}) == []


def test_licence_places_of_base_phrases(spark):
    texts = [
        "CC BY and cc-by; cc  by-nc", "All Rights. Reserved all rights reserved", "ALL\x00RIGHTS\x7fRESERVED", "ccby, é cc by", "by cc", "", None,
        "General Public License\n" * 3, "word " * 60_000 + "all rights reserved", "allé rights reserved",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, "cc by"), (None, "cc by cc by")], "doc_id long, text string").withColumns({"label": F.lit(1), "start": F.lit("x")})
    got = licence_labels(docs, BASE_PHRASES).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    shown = {i: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in by.items()}
    assert shown == {
        0: (8, 3, 0, 5, "cc-by"), 1: (6, 2, 0, 3, "reserved"), 2: (3, 1, 0, 0, "reserved"), 3: (4, 1, 2, 2, "cc-by"), 4: (2, 0, None, None, ""), 5: (0, 0, None, None, ""),
        6: (0, 0, None, None, ""), 7: (9, 3, 0, 6, "gpl"), 8: (60_003, 1, 60_000, 60_000, "reserved"), 9: (3, 0, None, None, ""),
    }
    assert len(got) == 13 and sorted(r.n_base for r in got if r.doc_id is None) == [1, 2]
    assert all((r.score, r.labels) == ((1.0, r.base_labels) if r.n_base else (0.0, "")) for r in got)
    assert licence_labels(docs.limit(0), BASE_PHRASES).count() == 0
    assert {r.labels for r in licence_labels(docs, []).collect()} == {""}


def test_notices_need_their_phrases_and_most_rare_words(spark):
    whole = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    texts = [whole, whole.replace("permitted", "kindly permitted"), whole.replace("binary", "other"), "use in forms", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."]
    docs = spark.createDataFrame([*enumerate(texts), *[(100 + i, "the work of a source in the public forms") for i in range(20)]], "doc_id long, text string")
    got = {r.doc_id: r for r in licence_labels(docs, [*BASE_PHRASES, *NOTICES]).collect()}
    assert [got[i].labels for i in range(6)] == ["bsd", "bsd", "", "", "mit", "gpl,gpl-3.0"]
    assert got[0].score == 1.0 and all(r.labels == "" for i, r in got.items() if i >= 100)
    only = licence_places(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text"), [exact_phrase("a b a", "x"), LicenceTemplate("y", "use in forms", ("use in forms",))])
    assert sorted((r.id, r.label, r.start) for r in only.collect()) == [(3, "y", 0)]


def test_nearest_entries_are_exact():
    """Distances that float32 can't tell apart, ties, and values near saturation."""
    rng = np.random.default_rng(3)
    for size, top in ((4, 300), (4, 1 << 26), (64, largest_component(64)), (1, 1 << 27)):
        entries = rng.integers(-top, top, (64, size))
        entries[10:20] = entries[:10]  # ties
        entries[20:40] = entries[0] + rng.integers(-1, 2, (20, size))
        parts = np.concatenate([entries[rng.integers(0, 64, 5000)] + rng.integers(-2, 3, (5000, size)), rng.integers(-top, top, (300, size))])
        index, error = nearest_entries(parts, entries)
        exact = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (index == exact.argmin(1)).all() and (error == exact.min(1)).all()


def test_vector_codes_edges(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.standard_normal(32)] for _ in range(90)]
    rows = [(i, v, i % 3 if i % 4 else None) for i, v in enumerate(vectors)]
    rows += [(200, None, 1), (201, [None, *vectors[0][1:]], 1), (202, [float("nan"), *vectors[0][1:]], 1), (203, [float("inf"), *vectors[0][1:]], 1), (204, [], 1), (205, [1.0] * 16, 1), (206, [1.0] * 31, 1)]
    rows += [(5, vectors[5], 1), (None, vectors[6], None), (207, [1e300, -1e300] * 16, 2)]
    coded, books = product_codes(spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", code string"))
    got = label_errors(coded).collect()
    q = {i: np.clip(np.floor(np.array(v) * 256), -largest_component(32), largest_component(32)).astype(np.int64) for i, v, _ in rows if i is not None and v and len(v) == 32 and None not in v and np.isfinite(v).all()}
    order = [*[(i, q[i]) for i in sorted([*q, 5])], (None, q[6])]
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(i is None, i or 0) for i, _ in order]
    x = np.array([v for _, v in order])
    want = [x[:64, 2 * p : 2 * p + 2].copy() for p in range(16)]
    near = lambda p: ((x[:, None, 2 * p : 2 * p + 2] - want[p]) ** 2).sum(2)
    for _ in range(2):
        for p in range(16):
            index = near(p).argmin(1)
            for e in set(index):
                want[p][e] = [sum(map(int, c)) // int((index == e).sum()) for c in x[index == e, 2 * p : 2 * p + 2].T]
    assert digest_codebooks(books) == digest_codebooks(want)
    codes = ["".join(f"{near(p)[i].argmin():02x}" for p in range(16)) for i in range(len(x))]
    assert sorted(r.code for r in got) == sorted(codes)
    sums = {}
    for r in got:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in got)
    empty, books = product_codes(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and books == []
    few, _ = product_codes(spark.createDataFrame(rows[:3], VECTORS))
    assert [r.error for r in few.collect()] == [0, 0, 0]
