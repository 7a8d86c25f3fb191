"""Edge cases of the corpus operators, their parts against plain loops, and the pipeline on a small folder of tables."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayloom.llm.common import crc_mod, labelled_sample
from assayloom.llm.decontaminate import benchmark_hits, contamination, decontaminated
from assayloom.llm.katz import katz_scores
from assayloom.llm.mixing import mix_sources
from assayloom.llm.neardup_embeddings import brute_force, index_size, near_duplicate_vectors
from assayloom.llm.ngram_join import jaccard_components
from assayloom.llm.quality import fit_quality, score_quality
from assayloom.llm.token_counts import RULES, token_counts
from assayloom.llm.token_store import token_digests
from assayloom.llm.toxicity import FtrlParameters, feature_places, fit_toxicity, score_toxicity
from assayloom.llm.url_rules import UrlRule, judge_urls, match_rules, mine_url_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<double>, label int"
RNG = np.random.default_rng(8)
VOCABULARY = [f"v{i}" for i in range(900)]


def words(n):
    return [str(x) for x in RNG.choice(VOCABULARY, n)]


def test_vectors_of_one_id_are_vectors_of_their_own(spark):
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, [1.0, 0.01, 0.0, 0.0], 0), (3, [0.01, 1.0, 0.0, 0.0], 0), (4, c, 0), (4, c, 0), (None, a, 0)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], VECTORS + ", rep string, links int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(frame).where("vec_id is not null").collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]
    assert [(r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(frame).where("vec_id is null").collect()] == [(0, None, False)]
    assert near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_of_the_vector_index(spark):
    """A skewed block of more classes than a cell holds, with planted pairs from just above the threshold upwards."""
    dim, pairs = 32, 250
    base = RNG.standard_normal((1500, dim))
    near = []
    for i, cosine in enumerate(np.linspace(0.931, 0.99, pairs)):
        u = base[i] / np.linalg.norm(base[i])
        v = RNG.standard_normal(dim)
        v -= (v @ u) * u
        near.append(cosine * u + math.sqrt(1 - cosine**2) * v / np.linalg.norm(v))
    every = [*base, *near]
    rows = [(i, [float(x) for x in v], 0 if i % 10 or i >= 1500 else 1) for i, v in enumerate(every)]
    assert index_size(1600, 0.93, 512, 0.998)[0] > 0
    want = brute_force(pd.DataFrame([r for r in rows if r[0] < pairs or r[0] >= 1500], columns=["vec_id", "embedding", "label"])).set_index("vec_id")
    got = near_duplicate_vectors(spark.createDataFrame(rows, VECTORS)).toPandas().set_index("vec_id")
    assert (got.loc[want.index].n_links <= want.n_links).all()
    assert got.loc[want.index].n_links.sum() >= 0.98 * want.n_links.sum()


def labelled(spark, n=60):
    rows = [(i, " ".join(words(40) + (["vile", "awful"] if i % 3 == 0 else ["kind"])), "en", "s", 1) for i in range(n)]
    labels = [(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ftrl_by_a_plain_loop(spark):
    docs, labels = labelled(spark)
    p = FtrlParameters(l1=2.0, epochs=4)
    learn = crc_mod("doc_id", 3) != 1
    model = fit_toxicity(docs, labels, learn, parameters=p)
    sample = sorted(labelled_sample(docs, labels, "toxic", learn, p.rows, p.seed).collect(), key=lambda r: (r.turn, r.doc_id))
    import pyarrow as pa

    z, n, zb, nb = Counter(), Counter(), 0.0, 0.0

    def weight(f):
        if abs(z[f]) <= p.l1:
            return 0.0
        return -(z[f] - math.copysign(p.l1, z[f])) / ((p.beta + math.sqrt(n[f])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for r in sample:
            own = sorted(set(feature_places(pa.array([r.text]), p.bits)[1].tolist()))
            w, b = {f: weight(f) for f in own}, -zb * p.alpha / (p.beta + math.sqrt(nb))
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - r.y
            for f in own:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / p.alpha * w[f]
                n[f] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / p.alpha * b
            nb += g * g
    want = {f: weight(f) for f in z if weight(f)}
    got = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert set(got) == set(want) and all(math.isclose(got[f], want[f], rel_tol=1e-6) for f in want)
    assert math.isclose(model.bias, -zb * p.alpha / (p.beta + math.sqrt(nb)), rel_tol=1e-6)


@pytest.mark.parametrize("fit,score", [(fit_toxicity, score_toxicity), (fit_quality, score_quality)])
def test_scores_of_odd_tables(spark, fit, score):
    docs, labels = labelled(spark)
    odd = docs.withColumn("score", F.lit("mine")).unionByName(docs.withColumn("score", F.lit("again"))).withColumn("features", F.lit(1))
    odd = odd.unionByName(spark.createDataFrame([(None, None, None, None, None, "a", 1), (7, "", None, None, None, "b", 1)], odd.schema))
    model = fit(docs, labels, F.lit(True))
    got = score(odd, model)
    assert got.columns.count("score") == 1 and dict(got.dtypes)["score"] == "double"
    assert got.count() == 122 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert score(docs.where("false"), model).count() == 0
    assert score(docs, fit(docs, labels.where("false"), F.lit(True))).select("score").distinct().collect()[0].score == 0.5
    one_class = score(docs, fit(docs, labels.where("toxic = 1"), F.lit(True)))
    assert one_class.where("score is null or score < 0 or score > 1").count() == 0


def test_mixing_of_odd_tables(spark):
    rows = [(i if i % 2 else None, " ".join(words(20)), None if i % 3 else "en", "a" if i < 30 else "b", 5, "k", "w", "r") for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[1], rows[1]], DOCS + ", key string, whole string, row string")
    levels = {"source": F.col("source"), "lang": F.col("lang")}
    got = mix_sources(docs, levels, {("a",): 0.75, ("b",): 0.25}, budget=400)
    taken = got.toPandas()
    assert set(taken.key) == {"k"} and set(taken.whole) == {"w"} and set(taken.row) == {"r"}
    assert 396 <= taken.mix_take.sum() <= 400
    by = taken.groupby("mix_source").mix_take.sum()
    assert abs(by["a"] - 300) <= 3 and abs(by["b"] - 100) <= 3
    assert all(len(t.split()) == n for t, n in zip(taken.text, taken.mix_take, strict=True))
    # b holds 600 words an epoch: what a branch can't give goes to its sibling
    short = mix_sources(docs, levels, {("a",): 0.25, ("b",): 0.75}, budget=1000, max_epochs=1).toPandas().groupby("mix_source").mix_take.sum()
    assert abs(short["b"] - 600) <= 3 and abs(short["a"] - 400) <= 3
    assert mix_sources(docs.where("false"), levels, {}, budget=10).count() == 0


def weighted(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def hits_by_hand(docs, items):
    """The best similarity of any item-sized window of each document, without any index."""
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for d, t in docs:
        s = runs(t.split())
        for k, item in items:
            x = runs(item.split())
            best = max((weighted(s[i : i + len(x)], x) for i in range(len(s))), default=0)
            if best >= 0.8:
                out[d, k] = best
    return out


def test_decontamination_against_all_windows(spark):
    items = [(k, " ".join(words(60))) for k in range(6)] + [(6, " ".join(words(5) * 12))]
    docs = []
    for i in range(120):
        w = items[i % 7][1].split()
        for place in RNG.choice(len(w), i % 4, replace=False):
            w[place] = "changed"
        docs.append((i, " ".join(words(30) + w[i % 5 :] + words(25))))
    want = hits_by_hand(docs, items)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.id, r.item_id): r.similarity for r in benchmark_hits(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and len(want) > 40
    exact = {(d, k) for (d, k), s in want.items() if s >= 0.9}
    assert exact <= set(got) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in got)


def test_decontamination_of_odd_tables(spark):
    passage = " ".join(words(40))
    rows = [(1, passage, "a", 9, "h"), (1, passage, "a", 9, "h"), (2, " ".join(words(40)), "a", 9, "h"), (2, " ".join(words(40)), "a", 9, "h"), (None, passage, "a", 9, "h"), (3, None, None, None, None), (4, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, text_hash long, hit string")
    bench = spark.createDataFrame([(1, passage), (1, " ".join(words(30))), (None, passage), (2, "")], "item_id long, text string")
    left = decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 2, 3, 4]
    assert contamination(docs, bench).where("contaminated").count() == 3
    assert decontaminated(docs.where("false"), bench).count() == 0


def test_token_spans_by_hand(spark):
    import base64

    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    rows = [(1, "One two. Three four!\n\n  five", "web"), (2, None, "naïve.  süß"), (3, "", ""), (4, "a. b. c. d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for rule in RULES:
        got = token_counts(docs, path, pattern, fields=("source", "text"), rule=rule, separator=" ").toPandas()
        assert got.n_crossing.sum() > 0
        for i, text, source in rows:
            mine = got[got.doc_id == i].sort_values(["start_char", "end_char"], kind="stable")
            whole = f"{source or ''} {text or ''}"
            starts = [len(whole[:c].encode()) for c in mine.start_char]
            ends = [len(whole[:c].encode()) for c in mine.end_char]
            want, at = Counter(), 0
            for token in enc.encode_ordinary(whole):
                low, at = at, at + len(enc.decode_single_token_bytes(token))
                parts = {k: min(at, e) - max(low, s) for k, (s, e) in enumerate(zip(starts, ends)) if min(at, e) > max(low, s)}
                chosen = {"start": min(parts), "end": max(parts), "majority": min(k for k in parts if parts[k] == max(parts.values()))}[rule]
                want[chosen] += 1
            assert mine.n_tokens.tolist() == [want[k] for k in range(len(mine))], (rule, i)


def test_url_rules_against_enumeration(spark):
    rows = [(sorted({f"t{x}" for x in RNG.integers(0, 6, 4)}), "block" if RNG.random() < 0.5 else "allow") for _ in range(120)]
    rules = mine_url_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.05, min_confidence=0.6)
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in rules.collect()}
    want, every = {}, {s for t, _ in rows for k in range(1, 1 << len(t)) for s in [tuple(x for j, x in enumerate(t) if k >> j & 1)]}
    for s in every:
        holds = [v for t, v in rows if set(s) <= set(t)]
        for v in ("allow", "block"):
            if holds.count(v) >= math.ceil(0.05 * len(rows)) and holds.count(v) / len(holds) >= 0.6:
                want[s, v] = (holds.count(v) / len(holds), holds.count(v) / len(rows))
    assert set(got) == set(want) and all(math.isclose(got[k][0], want[k][0]) for k in want)
    sets = [tuple(t) for t in {tuple(t) for t, _ in rows}]
    best = {tuple(r.tokens): r.mined for r in match_rules(spark.createDataFrame([(list(t),) for t in sets], "tokens array<string>"), rules).collect()}
    for t in sets:
        fits = [(-c, -s, -len(k), v, list(k)) for (k, v), (c, s) in got.items() if set(k) <= set(t)]
        assert best.get(t) == (min(fits)[3] if fits else None)


def test_empty_and_odd_tables(spark):
    docs, path = spark.createDataFrame([(None, "a b c d", None, None, 1), (5, "a b", None, None, 1), (5, "a b", None, None, 1), (6, None, None, None, None)], DOCS), public_tokenizers.path("word_bpe_49k.json")
    none = docs.where("false")
    assert token_digests(none, path).count() == 0 and sorted(r.start for r in token_digests(docs, path).collect()) == [0, 5, 8, 11]
    assert katz_scores(none, F.lit(True)).count() == 0 and katz_scores(docs, F.lit(True)).where("score < 0").count() == 4
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).orderBy("doc_id").collect()] == [(None, 2, None), (5, 1, 5), (5, 1, 5), (6, 0, 6)]
    pages = spark.createDataFrame([(1, "http://a.org/x", "mine"), (1, "http://a.org/x", "mine"), (None, None, None)], "page_id long, url string, host string")
    assert sorted((r.host, r.verdict) for r in judge_urls(pages, [UrlRule("com", "/", "block")]).collect()) == [("", "allow"), ("a.org", "allow"), ("a.org", "allow")]
    assert judge_urls(pages.where("false"), [UrlRule("org", "/", "block")]).count() == 0


def test_pipeline_on_a_small_folder(spark, tmp_path):
    docs, labels = labelled(spark, 60)
    passage, copy, near = " ".join(words(50)), " ".join(words(80)), words(120)
    more = [(100, passage + " " + " ".join(words(30)), "en", "s", 1), (101, copy, "en", "s", 1), (102, copy, "en", "s", 1), (103, " ".join(near), "de", None, 1), (104, " ".join([*near, "end"]), None, "s", 1),
            (105, None, None, None, None), (106, "", "en", "s", 0), (None, "no id at all here", "en", "s", 1), (107, " ".join(words(20_000)), "en", "s", 1), (108, "one text", "en", "s", 1), (108, "another text of this id", "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(more, DOCS)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame.columns
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == before
        kept[name] = [r.doc_id for r in frame.collect()]
    assert {100, 101, 102, 103, 104, 105, 106, 107, 108, None} <= set(kept["toxicity"])
    assert kept["near duplicates"].count(101) == 1 and not {102, 104} & set(kept["near duplicates"]) and kept["near duplicates"].count(108) == 1
    assert 100 not in kept["decontamination"] and {101, 103, 105, 106, 107, None} <= set(kept["decontamination"])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == len(kept["mixing"])
    spark.createDataFrame([], DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
