"""The corpus operators on small fixtures, against brute force, exact round trips and edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assayloom.llm.common import crc_mod
from assayloom.llm.decontaminate import contamination, decontaminated
from assayloom.llm.katz import discounted, good_turing, katz_scores
from assayloom.llm.mixing import mix_sources
from assayloom.llm.neardup_embeddings import brute_force, near_duplicate_vectors
from assayloom.llm.ngram_join import jaccard_components
from assayloom.llm.quality import fit_quality, score_quality
from assayloom.llm.token_counts import token_counts
from assayloom.llm.token_store import token_digests
from assayloom.llm.toxicity import fit_toxicity, score_toxicity
from assayloom.llm.url_rules import UrlRule, judge_urls, mine_url_rules

RNG = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def corpus(spark):
    base = [text(int(n)) for n in RNG.integers(30, 120, 40)]
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 2}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "src0", 1) for i in range(5)]  # copies
    rows += [(200 + i, base[i] + " extra", "en", "src1", 1) for i in range(5)]  # near copies
    rows += [(300, "", None, None, 0), (301, None, "fr", "licensed", None), (302, "One  two", "en", "src0", 8), (303, "one two", "en", "src0", 7), (304, " \t\n", "en", "src0", 3)]
    rows += [(400, text(30) + "\n" + text(40000), "es", "src0", 1)]  # very long
    return spark.createDataFrame(rows, DOCS)


def sets(t, k):
    w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(pdf, k, percent):
    s = {r.doc_id: sets(r.text, k) for r in pdf.itertuples()}
    comp = {i: i for i in s}
    links = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    for _ in range(len(s)):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return s, comp


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_join(corpus, k, percent):
    s, comp = components(corpus.toPandas(), k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(corpus, k, percent).collect()}
    assert got == {i: (len(s[i]), comp[i]) for i in s}


@pytest.mark.parametrize("rare,outside", [(29, 0), (21, 5)])
def test_jaccard_join_within_a_group(spark, rare, outside):
    """1, 2 and 3 share their rarest shingles and their size, so they are one group; 2 and 3 are linked, neither is with 1, the hub.

    With outside, a text of one shingle shares the last shingle of their prefix.
    """
    made = iter(f"u{i}" for i in range(100_000))
    some = lambda n: [next(made) for _ in range(n)]
    start, common, one, two = some(rare), some(8), some(96 - rare), some(91 - rare)
    tails = [one, two + some(5), two + some(5)]
    rows = [(i + 1, start + common + t) for i, t in enumerate(tails)]
    rows += [(100 + k, some(150) + common + tails[k % 3] + some(20)) for k in range(18)]
    rows += [(200, start[:outside])] if outside else []
    frame = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], DOCS)
    s, comp = components(frame.toPandas(), 5, 80)
    assert [len(s[i]) for i in (1, 2, 3)] == [100] * 3 and [comp[i] for i in (1, 2, 3)] == [1, 2, 2]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame, 5, 80).collect()}
    assert got == {i: (len(s[i]), comp[i]) for i in s}


def test_jaccard_join_of_nothing(spark):
    assert jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_vectors(spark):
    base = RNG.standard_normal((30, 16))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i] * 2 + 0.02 * RNG.standard_normal(16)], i % 2) for i in range(20)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, rows[0][1], None), (204, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute_force(pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"label": object})).set_index("vec_id")
    got = near_duplicate_vectors(frame).toPandas().set_index("vec_id").loc[want.index]
    assert list(got.n_links) == list(want.n_links) and list(got.component_id) == list(want.component_id)


def test_token_store_round_trip(corpus):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, start = Tokenizer.from_file(path), 0
    got = {r.id: r for r in token_digests(corpus, path, end_id=1).collect()}
    for r in sorted(corpus.collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (start, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_words_are_encoded_as_written():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from assayloom.llm.encoding import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["a <|ENDOFTEXT|> b", "x<|StartOfText|>y", "<|endoftext|>", "H\u0331 aH\u0331b", "J\u030c", "T\u0308", "HELLO, World!! hello", "\u00c9T\u00c9 Stra\u00dfe", None, ""]
    ids, starts = Encoder(path).texts(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_counts_add_up(corpus):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    got = token_counts(corpus, path, public_tokenizers.PATTERN).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("sections")).collect()
    want = {r.doc_id: (len(enc.encode_ordinary(r.text or "")), len((r.text or "").split("\n"))) for r in corpus.collect()}
    assert {r.doc_id: r.n for r in got} == {i: n for i, (n, _) in want.items()}
    assert {r.doc_id: r.sections for r in got}[400] == 2


def test_katz_base_and_normalisation(corpus):
    turn = crc_mod("doc_id", 10)
    got = {r.doc_id: r for r in katz_scores(corpus, turn != 0).collect()}
    tokens = {r.doc_id: [*"".join(c.lower() if c.isascii() else c for c in (r.text or "")).split(), None] for r in corpus.collect()}
    learnt = [i for i in tokens if zlib.crc32(str(i).encode()) % 10 != 0]
    count = Counter(w for i in learnt for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, words in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words), sum(w in count for w in words), n, i not in learnt)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def katz_by_hand(rows, order):
    """rows (text, learns) -> the score of each, by the definition, one n-gram at a time."""
    seqs = [([None, *"".join(c.lower() if c.isascii() else c for c in (t or "")).split(), None], learns) for t, learns in rows]
    counts = [Counter(tuple(w[e - m + 1 : e + 1]) for w, learns in seqs if learns for e in range(max(m - 1, 1), len(w))) for m in range(1, order + 1)]
    d = [good_turing([sum(c == r for c in x.values()) for r in range(1, 7)]) for x in counts]
    n = sum(counts[0].values())
    cut = lambda g: float(discounted(np.array([counts[len(g) - 1][g]]), d[len(g) - 1])[0])
    total = lambda c: counts[len(c) - 1][c]
    unknown = 1 - sum(map(cut, counts[0])) / n
    after = {}
    for x in counts[1:]:
        for g in x:
            after.setdefault(g[:-1], []).append(g)
    weights = {}

    def p(g):
        if len(g) == 1:
            return cut(g) / n if counts[0][g] else unknown
        return cut(g) / total(g[:-1]) if counts[len(g) - 1][g] else weight(g[:-1]) * p(g[1:])

    def weight(c):
        if c not in weights:
            seen = after.get(c, [])
            weights[c] = max(1 - sum(map(cut, seen)) / total(c), 1e-15) / max(1 - sum(p(g[1:]) for g in seen), 1e-15) if total(c) and seen else 1.0
        return weights[c]

    return [sum(math.log10(p(tuple(w[max(0, e - order + 1) : e + 1]))) for e in range(1, len(w))) for w, _ in seqs]


@pytest.mark.parametrize(("times", "order"), [(1, 2), (2, 2), (1, 3), (2, 3), (1, 4)])
def test_katz_by_definition_and_repeated_rows(corpus, times, order):
    docs = corpus if times == 1 else corpus.union(corpus)
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), katz_by_hand([(r.text, zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in rows], order), strict=True))
    got = katz_scores(docs, crc_mod("doc_id", 10) != 0, order=order).collect()
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9), r.doc_id


def test_decontamination(spark, corpus):
    passage = text(60)
    bench = spark.createDataFrame([(1, passage), (2, text(50)), (3, None), (4, "")], "item_id long, text string")
    planted = [(900, text(80) + " " + passage + " " + text(50)), (901, passage.upper()), (902, text(200)), (903, " ".join(passage.split()[:20]))]
    docs = corpus.unionByName(spark.createDataFrame([(i, t, "en", "x", 1) for i, t in planted], DOCS))
    got = {r.doc_id for r in contamination(docs, bench).where("contaminated").collect()}
    assert got == {900, 901}
    assert decontaminated(docs, bench).count() == docs.count() - 2
    assert decontaminated(docs, bench.where("false")).count() == docs.count()


def test_mixing_takes_the_budget(corpus):
    levels = {"source": F.col("source"), "lang": F.col("lang")}
    got = mix_sources(corpus, levels, {("src0",): 0.5, ("src1",): 0.5}, budget=1000).toPandas()
    assert 997 <= got.mix_take.sum() <= 1000
    assert (got.mix_take <= got.mix_tokens).all()
    again = mix_sources(corpus, levels, {("src0",): 0.5, ("src1",): 0.5}, budget=1000).toPandas()
    assert sorted(got.doc_id) == sorted(again.doc_id)


def test_url_rules(spark):
    rules = [UrlRule("org", "/", "allow"), UrlRule("example.org", "/es/", "block"), UrlRule("com", "/de/", "block")]
    urls = ["HTTP://A.EXAMPLE.ORG/es/1?x", "https://x.org", "https://corg/es/", "http://b.com/de/2#f", "nothing", None, "https://example.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in judge_urls(pages, rules).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/") and got[1] == ("x.org", "", None) and got[2] == ("corg", "/es/", None)
    assert got[3] == ("b.com", "/de/2", "com/de/") and got[4] == got[5] == ("", "", None) and got[6] == ("example.org", "/", "org/")


def test_url_rules_of_four_tokens(spark):
    rows = [(list(t), v) for t, v in (("abcd", "block"), ("abc", "allow"), ("abd", "allow"), ("acd", "allow"), ("bcd", "allow")) for _ in range(20)]
    got = mine_url_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()
    assert [r.tokens for r in got if r.verdict == "block"] == [list("abcd")]


@pytest.mark.parametrize("fit,score,label", [(fit_toxicity, score_toxicity, "toxic"), (fit_quality, score_quality, "quality")])
def test_classifiers_on_held_out_rows(spark, fit, score, label):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = fit(docs, labels, crc_mod("doc_id", 3) != 1)
    judged = score(docs.unionByName(spark.createDataFrame([(-1, None, None, None, None), (-2, "", "", "", 0)], DOCS)), model)
    got = judged.join(labels, "doc_id").where(crc_mod("doc_id", 3) == 1).select("score", label).toPandas()
    right = ((got.score >= 0.5) == (got[label] == 1)).mean()
    assert right > 0.85, right
    assert judged.where("score is null or score < 0 or score > 1").count() == 0
