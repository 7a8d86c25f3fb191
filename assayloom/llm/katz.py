"""Katz backoff language model over words: counted, normalised and evaluated where the texts are partitioned."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, bounded_batches, chain, discard, materialize, materialize_clean, mix, string_hashes

#: The hash of the sign that begins and ends a text; it is no word's.
END = np.uint64(0xA0761D6478BD642F)
#: Counts up to this one are discounted by Good-Turing.
CUTOFF = 5
#: N-grams that a bucket is asked for at most, on average, each time they occur.
BUCKET_GRAMS = 2_000_000
#: Shares of the blocks that are scored one after another: only one share's texts and totals lie in shuffle files at a time.
SHARES = 4
#: What is taken from each higher count, so that every context keeps mass for words not seen after it.
SLIVER = 1e-3


def pack(numbers: np.ndarray) -> bytes:
    """Compressed little-endian numbers, byte by byte place."""
    wide = np.ascontiguousarray(numbers)
    return zstandard.ZstdCompressor(level=1).compress(wide.view(np.uint8).reshape(len(wide), wide.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw, width = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def good_turing(counts: list[int]) -> np.ndarray:
    """Katz's discount ratios d[0..CUTOFF] from counts[r - 1], the n-grams that occur r times, r = 1..CUTOFF + 1.

    Where the estimate is no ratio in (0, 1), as with few or no n-grams of some count, r / (r + 1/2) stands in.
    """
    n = [0, *counts]
    share = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
    d = np.ones(CUTOFF + 1)
    for r in range(1, CUTOFF + 1):
        ratio = ((r + 1) * n[r + 1] / (n[r] * r) - share) / (1 - share) if n[r] and share < 1 else 0.0
        d[r] = ratio if 0 < ratio < 1 else r / (r + 0.5)
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discounted counts; 0 stays 0."""
    return np.where(counts > CUTOFF, counts - SLIVER, counts * d[np.minimum(counts, CUTOFF)])


class Sequences:
    """Texts as one row of hashes: the sign END, the words, END again, text after text."""

    def __init__(self, vocabulary: np.ndarray, ids: np.ndarray, lengths: np.ndarray):
        """ids: the words of all texts as places in vocabulary; lengths: words of each text."""
        size = lengths + 2
        ends = np.cumsum(size)
        self.begin = ends - size
        self.doc = np.repeat(np.arange(len(lengths)), size)
        self.place = np.arange(int(size.sum())) - self.begin[self.doc]
        self.hashes = np.full(len(self.doc), END, np.uint64)
        inner = (self.place > 0) & (self.place < (size - 1)[self.doc])
        self.hashes[inner] = vocabulary[ids]

    def grams(self, order: int) -> list[np.ndarray]:
        """keys[m - 1][p]: the hash of the m-gram that ends at p; it holds where place[p] >= max(m - 1, 1), and for m = 1 everywhere."""
        keys = [mix(self.hashes)]
        for _ in range(1, order):
            keys.append(chain(np.concatenate([[np.uint64(0)], keys[-1][:-1]]), self.hashes))
        return keys

    def held(self, m: int) -> np.ndarray:
        """Places where an m-gram ends."""
        return np.flatnonzero(self.place >= max(m - 1, 1))


TEXT = "block long, ids array<long>, learns binary, vocabulary binary, words binary, lengths array<long>"


def _filled(part, most_bytes):
    """The rows of part in batches that each hold about most_bytes of text, whatever batches they came in."""
    held, size = [], 0
    for batch in part:
        for at, rows in batches(batch["text"], max(1, most_bytes // 6)):
            piece = batch.slice(at, rows)
            more = pc.sum(pc.binary_length(piece["text"])).as_py() or 0
            if held and size + more > most_bytes:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(piece)
            size += more
    if held:
        yield pa.concat_batches(held)


def _blocks(part, most_bytes):
    """Texts as rows of TEXT: vocabulary as hashes, words as places in it, lengths in words; block numbers the rows of all partitions."""
    block = TaskContext.get().partitionId() << 33
    for piece in _filled(part, most_bytes):
        words = Words(piece["text"])
        learns = piece["learns"].to_numpy(zero_copy_only=False).astype(bool)
        columns = {
            "block": pa.array([block], pa.int64()),
            "ids": pa.array([piece["id"].to_pylist()], pa.list_(pa.int64())),
            "learns": pa.array([np.packbits(learns).tobytes()], pa.binary()),
            "vocabulary": pa.array([mix(string_hashes(words.vocabulary)).tobytes()], pa.binary()),
            "words": pa.array([pack(words.ids.astype(np.uint32))], pa.binary()),
            "lengths": pa.array([words.counts], pa.list_(pa.int64())),
        }
        yield pa.RecordBatch.from_pydict(columns)
        block += 1


def _block_texts(texts: pa.Table | pa.RecordBatch, row: int = 0):
    """(ids, learns, Sequences) of one row of TEXT."""
    value = lambda c: texts[c][row].as_py()
    ids, lengths = value("ids"), np.array(value("lengths"), np.int64)
    learns = np.unpackbits(np.frombuffer(value("learns"), np.uint8), count=len(ids)).astype(bool)
    return ids, learns, Sequences(np.frombuffer(value("vocabulary"), np.uint64), unpack(value("words"), np.uint32).astype(np.int64), lengths)


REQUEST = "m int, bucket int, block long, grams binary, times binary, asks binary"
COUNTED = "kind string, m int, bucket int, block long, times binary, own binary, asked binary, stats array<long>"
SCORED = (
    "kind string, block long, row int, id long, held_out boolean, n_tokens long, n_known long, base_score double, part_score double,"
    " m int, context long, times long, bucket int, contexts binary, taken binary, lower binary, total binary"
)
WEIGHT = "m int, context long, weight double"


def _bucket_slices(keys: np.ndarray, bits: int):
    """(bucket, slice) over sorted keys: the top bits name the bucket."""
    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    cuts = [0, *cuts.tolist(), len(keys)]
    return [(b, slice(cuts[b], cuts[b + 1])) for b in range(1 << bits) if cuts[b + 1] > cuts[b]]


def _requests(part, m, bits, contexts):
    """Each block's distinct m-grams with their counts in its learning texts (0 for others), and, if they are contexts of others, whether a text that isn't learnt from has them."""
    for batch in part:
        for row in range(batch.num_rows):
            block = batch["block"][row].as_py()
            _, learns, seq = _block_texts(batch, row)
            at = seq.held(m)
            keys, inverse = np.unique(seq.grams(m)[m - 1][at], return_inverse=True)
            learnt = learns[seq.doc[at]]
            times = np.bincount(inverse, learnt, len(keys)).astype(np.uint32)
            asks = np.bincount(inverse, ~learnt, len(keys)) > 0
            rows = [(m, b, block, pack_sorted(keys[s]), pack(times[s]), np.packbits(asks[s]).tobytes() if contexts else b"") for b, s in _bucket_slices(keys, bits)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["m", "bucket", "block", "grams", "times", "asks"])
        pa.default_memory_pool().release_unused()


def _count(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
    """One bucket of one order: sums over its total counts as a row `stats`, and for each block the totals of what it asked for."""
    m, bucket = key[0].as_py(), key[1].as_py()
    blocks = got["block"].to_pylist()
    grams = [unpack_sorted(x) for x in got["grams"].to_pylist()]
    keys, first, inverse = np.unique(np.concatenate(grams), return_index=True, return_inverse=True)
    asks = [np.unpackbits(np.frombuffer(a, np.uint8), count=len(g)) for a, g in zip(got["asks"].to_pylist(), grams, strict=True)]
    asked = np.bincount(inverse, np.concatenate(asks)) > 0
    total = np.bincount(inverse, np.concatenate([unpack(x, np.uint32) for x in got["times"].to_pylist()])).astype(np.int64)
    own = np.zeros(len(inverse), bool)
    own[first] = total > 0
    seen = total > 0
    stats = [int((total == r).sum()) for r in range(1, CUTOFF + 2)] + [int(total.sum()), int(seen.sum())]
    ends = np.cumsum([len(x) for x in grams])
    parts = [slice(e - len(x), e) for x, e in zip(grams, ends, strict=True)]
    n = len(parts)
    return pa.table(
        {
            "kind": pa.array(["stats"] + ["reply"] * n),
            "m": pa.array([m] * (n + 1), pa.int32()),
            "bucket": pa.array([bucket] * (n + 1), pa.int32()),
            "block": pa.array([None, *blocks], pa.int64()),
            "times": pa.array([None] + [pack(total[inverse[s]]) for s in parts], pa.binary()),
            "own": pa.array([None] + [np.packbits(own[s]).tobytes() for s in parts], pa.binary()),
            "asked": pa.array([None] + [np.packbits(asked[inverse[s]]).tobytes() if asked.any() else b"" for s in parts], pa.binary()),
            "stats": pa.array([stats] + [None] * n, pa.list_(pa.int64())),
        }
    )


def _score_block(texts: pa.Table, replies: pa.Table, order: int, bits: int, discounts: list[np.ndarray], n_all: int, v_all: int) -> pa.Table:
    """Scores of one block's texts from the totals of its n-grams, and its share of the context sums.

    A text's part_score has all but the backoff weights. Rows of kind `back` name the contexts whose
    weights it still needs; rows of kind `context` sum, over the n-grams that this block owns, the
    discounted counts and the lower-order probabilities, each n-gram once in the whole corpus, packed
    by bucket like the requests. Contexts
    that no text outside the learnt ones has are left out: a learnt text has no unseen n-gram, so
    nobody backs off from them.
    """
    block = texts["block"][0].as_py()
    ids, learns, seq = _block_texts(texts)
    grams = seq.grams(order)
    wanted: dict[int, dict[int, tuple[bytes, np.ndarray, np.ndarray]]] = {m: {} for m in range(1, order + 1)}
    for m, b, times, own, asked in zip(*(replies[c].to_pylist() for c in ("m", "bucket", "times", "own", "asked")), strict=True):
        wanted[m][b] = (times, np.frombuffer(own, np.uint8), np.frombuffer(asked, np.uint8))
    n = len(seq.doc)
    count, owned, needed = [np.zeros(n, np.int64) for _ in range(order)], [np.zeros(n, bool) for _ in range(order)], [np.zeros(n, bool) for _ in range(order)]
    for m in range(1, order + 1):
        at = seq.held(m)
        keys, first, inverse = np.unique(grams[m - 1][at], return_index=True, return_inverse=True)
        got = [(unpack(t, np.int64), o, a) for _, (t, o, a) in sorted(wanted[m].items())]
        total = np.concatenate([np.zeros(0, np.int64), *(t for t, _, _ in got)])
        own, asked = (np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(x[i], count=len(x[0])) for x in got)]).astype(bool) for i in (1, 2))
        if len(total) != len(keys):
            raise RuntimeError("a block lacks the totals of some of its n-grams")
        count[m - 1][at] = total[inverse]
        owned[m - 1][at[first[own]]] = True
        needed[m - 1][at] = asked[inverse]
        if m == 1:  # the first sign of a text is context alone and has the count of END
            for kept in (count[0], needed[0]):
                kept[seq.begin] = kept[np.append(seq.begin[1:], n) - 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = sum(r * discounts[0][r] * n_r for r, n_r in enumerate(discounts[-1][:CUTOFF], 1)) if n_all else 0.0
        few, few_types = sum(r * n_r for r, n_r in enumerate(discounts[-1][:CUTOFF], 1)), sum(discounts[-1][:CUTOFF])
        kept += (n_all - few) - SLIVER * (v_all - few_types)
        unknown = 1 - kept / n_all if n_all else 1.0
        p = [np.where(count[0] > 0, discounted(count[0], discounts[0]) / max(n_all, 1), unknown)]
        for m in range(2, order + 1):
            before = np.concatenate([[0], count[m - 2][:-1]])
            p.append(np.where(count[m - 1] > 0, discounted(count[m - 1], discounts[m - 1]) / np.maximum(before, 1), 0.0))
    tokens = np.flatnonzero(seq.place > 0)
    doc, place = seq.doc[tokens], seq.place[tokens]
    level, done = np.log10(p[0][tokens]), np.zeros(len(tokens), bool)
    backs = []
    for m in range(order, 1, -1):
        possible = (place >= m - 1) & ~done
        seen = possible & (count[m - 1][tokens] > 0)
        level[seen] = np.log10(p[m - 1][tokens][seen])
        done |= seen
        open_ = np.flatnonzero(possible & ~seen & (count[m - 2][tokens - 1] > 0))
        if len(open_):
            pair = np.stack([doc[open_].astype(np.uint64), grams[m - 2][tokens[open_] - 1]], 1)
            order_of = np.lexsort((pair[:, 1], pair[:, 0]))
            pair = pair[order_of]
            new = np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)])
            starts = np.flatnonzero(new)
            backs.append((m, pair[starts, 0].astype(np.int32), pair[starts, 1].copy().view(np.int64), np.diff(np.append(starts, len(pair)))))
    known = count[0][tokens] > 0
    base = np.log10((count[0][tokens] + 0.1) / (n_all + 0.1 * (v_all + 1)))
    rows = len(ids)
    tables = [
        {
            "kind": ["doc"] * rows, "row": np.arange(rows), "id": ids, "held_out": ~learns,
            "n_tokens": np.bincount(doc, minlength=rows), "n_known": np.bincount(doc, known, rows).astype(np.int64),
            "base_score": np.bincount(doc, base, rows), "part_score": np.bincount(doc, level, rows),
        }
    ]
    tables += [{"kind": ["back"] * len(r), "row": r, "m": np.full(len(r), m), "context": c, "times": t} for m, r, c, t in backs]
    for m in range(2, order + 1):
        at = np.flatnonzero(owned[m - 1])
        at = at[needed[m - 2][at - 1]]
        contexts, inverse = np.unique(grams[m - 2][at - 1], return_inverse=True)
        one = np.zeros(len(contexts), np.int64)
        one[inverse] = count[m - 2][at - 1]
        taken, lower = (np.bincount(inverse, x, len(contexts)) for x in (discounted(count[m - 1][at], discounts[m - 1]), p[m - 2][at]))
        cut = _bucket_slices(contexts, bits)
        tables.append(
            {
                "kind": ["context"] * len(cut), "m": np.full(len(cut), m), "bucket": [b for b, _ in cut], "contexts": [pack_sorted(contexts[s]) for _, s in cut],
                "taken": [pack(taken[s]) for _, s in cut], "lower": [pack(lower[s]) for _, s in cut], "total": [pack(one[s]) for _, s in cut],
            }
        )
    types = {"kind": pa.string(), "block": pa.int64(), "row": pa.int32(), "id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "part_score": pa.float64(), "m": pa.int32(), "context": pa.int64(), "times": pa.int64(), "bucket": pa.int32(), "contexts": pa.binary(), "taken": pa.binary(), "lower": pa.binary(), "total": pa.binary()}
    return pa.concat_tables([pa.table({c: pa.array([block] * len(t["kind"]), k) if c == "block" else pa.array(t[c], k) if c in t else pa.nulls(len(t["kind"]), k) for c, k in types.items()}) for t in tables])


def _weigh(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
    """The backoff weights of one bucket's contexts of one order, from the sums that the blocks made."""
    contexts = np.concatenate([unpack_sorted(x) for x in got["contexts"].to_pylist()])
    keys, inverse = np.unique(contexts, return_inverse=True)
    some = lambda c, kind: np.concatenate([unpack(x, kind) for x in got[c].to_pylist()])
    taken, lower = (np.bincount(inverse, some(c, np.float64), len(keys)) for c in ("taken", "lower"))
    total = np.zeros(len(keys), np.int64)
    total[inverse] = some("total", np.int64)
    weight = np.maximum(1 - taken / total, 1e-15) / np.maximum(1 - lower, 1e-15)
    return pa.table({"m": pa.array(np.full(len(keys), key[0].as_py()), pa.int32()), "context": pa.array(keys.view(np.int64)), "weight": pa.array(weight)})


def katz_scores(documents: DataFrame, learns: Column, order: int = 3, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every text, learning from all texts where `learns` holds.

    score: log10 probability of the text under a Katz model of the given order, closing sign included.
    A text begins after the closing sign. Words that the learnt texts lack share the mass that
    Good-Turing takes from the single words.

    Blocks of texts (6 MB) are written once as hashes and read twice, so both readings see the same
    texts whatever order the input comes in. Order by order, each block sends its distinct n-grams once to the buckets that count them and
    gets totals back in the order it asked, so what moves is a few bytes for each distinct n-gram
    of a block. Buckets are ranges of a 64-bit hash, so frequent words and contexts never meet in
    one task; their number follows from the words of all texts (BUCKET_GRAMS) and is at least twice
    spark.sql.shuffle.partitions. Totals and backoff weights are written in partitions; nothing of
    them passes the driver but CUTOFF + 3 sums for each order. Blocks are scored in SHARES turns;
    then blocks and totals are deleted, as nothing else reads them. The sums of contexts travel packed
    to buckets too. Backoff weights are exactly normalised: the mass not taken
    by a context's discounted n-grams over the lower-order mass of the words not seen after it.

    A null text is empty: one token. Where `learns` is null a text is not learnt from; held_out is
    its negation. Repeated rows are scored and, if they learn, counted each time.
    """
    spark = documents.sparkSession
    texts = bounded_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    blocks = materialize(texts.mapInArrow(lambda part: _blocks(part, block_bytes), TEXT), "lz4")
    size = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n + 2))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size / BUCKET_GRAMS)
    bits = max(6, math.ceil(math.log2(buckets)))

    def counts(m: int) -> DataFrame:
        asked = blocks.mapInArrow(lambda part: _requests(part, m, bits, m < order), REQUEST)
        return materialize_clean(asked.groupBy("m", "bucket").applyInArrow(_count, COUNTED), "lz4")

    counted = reduce(DataFrame.unionByName, [counts(m) for m in range(1, order + 1)])
    stats = counted.where("kind = 'stats'").select("m", F.posexplode("stats").alias("k", "x")).groupBy("m", "k").agg(F.sum("x").alias("x")).collect()  # CUTOFF + 3 numbers an order
    by = {(r.m, r.k): r.x for r in stats}
    lines = [[by.get((m, k), 0) for k in range(CUTOFF + 3)] for m in range(1, order + 1)]
    discounts = [good_turing(x[: CUTOFF + 1]) for x in lines] + [np.array(lines[0][: CUTOFF + 1])]
    n_all, v_all = lines[0][CUTOFF + 1], lines[0][CUTOFF + 2]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score_block(left, right, order, bits, discounts, n_all, v_all)

    replies = counted.where("kind = 'reply'").select("block", "m", "bucket", "times", "own", "asked")

    def scores(i: int) -> DataFrame:
        mine = F.pmod(F.hash("block"), F.lit(SHARES)) == i
        return materialize_clean(blocks.where(mine).groupBy("block").cogroup(replies.where(mine).groupBy("block")).applyInArrow(score, SCORED))

    scored = reduce(DataFrame.unionByName, [scores(i) for i in range(SHARES)])
    discard(blocks)
    discard(counted)
    sums = scored.where("kind = 'context'").select("m", "bucket", "contexts", "taken", "lower", "total")
    weights = materialize_clean(sums.groupBy("m", "bucket").applyInArrow(_weigh, WEIGHT))
    back = scored.where("kind = 'back'").select("block", "row", "m", "context", "times").join(weights, ["m", "context"], "left")
    known = F.when(F.col("weight").isNull(), F.raise_error(F.lit("a context has no backoff weight")).cast("double")).otherwise(F.log10("weight"))
    back = back.groupBy("block", "row").agg(F.sum(F.col("times") * known).alias("backed"))
    out = scored.where("kind = 'doc'").join(back, ["block", "row"], "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score",
        (F.col("part_score") + F.coalesce("backed", F.lit(0.0))).alias("score"),
    )
