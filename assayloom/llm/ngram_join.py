"""Word n-gram Jaccard self-join: grouped prefix filtering, hub rounds, exact verification."""

from __future__ import annotations

import ctypes
import hashlib
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batches, bounded_batches, chain, clean_shuffles, materialize, mix
from .components import connected_components

PAD = np.uint64(0x5851F42D4C957F2D)
SEGMENTS, ADDERS = 64, 24
#: Words of 64 bits in the parities of a set.
PARITY_WORDS = 8


def shingle_sets(texts: pa.Array, words_each: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; shorter texts are one shingle, empty ones none."""
    words = Words(texts)
    h, ends = words.hashes(), words.starts[1:][words.doc]
    at = np.arange(len(h))
    s = mix(h)
    for k in range(1, words_each):
        inside = at + k < ends
        s = chain(s, np.where(inside, h[np.minimum(at + k, max(len(h) - 1, 0))], PAD))
    whole = (at + words_each <= ends) | (at == words.starts[:-1][words.doc])
    rows, s = words.doc[whole], s[whole]
    cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        x = np.sort(s[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if b > a else x)
    return out


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether a set has an odd number of shingles in each of 64 * PARITY_WORDS hash buckets, as bits.

    Those of two sets differ in at most as many bits as there are shingles in one set alone.
    """
    bits = 64 * PARITY_WORDS
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def give_back() -> None:
    """Return freed memory to the system: a worker waits for later stages beside others that work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def _sets_of(part, words_each):
    """(slice of the batch, its shingle sets), block by block."""
    for batch in part:
        for at, size in batches(batch["text"]):
            piece = batch.slice(at, size)
            yield piece, shingle_sets(piece["text"], words_each)
        give_back()


def shingle_sketch(texts: DataFrame, words_each: int, bits: int) -> np.ndarray:
    """In how many texts the shingles of each of 2 ** bits hash buckets occur: one number a bucket over all texts.

    It bounds each shingle's document count from above and only orders shingles, so any sketch
    gives the same links. Its size is fixed by bits (4 MB for 20); tasks add up their own counts
    first and partial sums meet in two steps.
    """

    def add_up(part, pieces_of):
        total = np.zeros((SEGMENTS, 1 << (bits - 6)), np.uint32)
        for batch in part:
            pieces_of(batch, total)
        rows = [(k, _pack_counts(x)) for k, x in enumerate(total) if x.any()]
        yield pa.RecordBatch.from_pydict({"segment": pa.array([k for k, _ in rows], pa.int32()), "counts": pa.array([x for _, x in rows], pa.binary())})

    def count(batch, total):
        for _, sets in _sets_of([batch], words_each):
            if sets:
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32).reshape(total.shape)

    def add(batch, total):
        for k, packed in zip(batch["segment"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            _add_counts(total[k], packed)

    schema = "segment int, counts binary"
    own = texts.select("text").mapInArrow(lambda part: add_up(part, count), schema)
    for n in (ADDERS, 1):  # a table of fixed size from each task, so the last one gets ADDERS tables
        own = own.repartition(n).mapInArrow(lambda part: add_up(part, add), schema)
    out = np.zeros((SEGMENTS, 1 << (bits - 6)), np.uint32)
    for k, packed in zip(*own.toArrow().to_pydict().values(), strict=True):  # 64 rows
        _add_counts(out[k], packed)
    return np.minimum(out.reshape(-1), (1 << 20) - 1)


def _pack_counts(counts: np.ndarray) -> bytes:
    """The places that are not 0 and their counts, or all counts where that is shorter."""
    at = np.flatnonzero(counts).astype(np.uint32)
    if 2 * len(at) < len(counts):
        return b"s" + at.tobytes() + counts[at].tobytes()
    return b"d" + counts.tobytes()


def _add_counts(total: np.ndarray, packed: bytes) -> None:
    numbers = np.frombuffer(packed, np.uint32, offset=1)
    if packed[:1] == b"d":
        total += numbers
    else:
        at, n = numbers.reshape(2, -1)
        total[at] += n


def _signatures(texts: DataFrame, sketch, words_each: int, percent: int, bits: int, rest: bool = False, members=None) -> DataFrame:
    """(id, n, digest, grp, parity, prefix): size, digest and parities of each set, and its rarest shingles, as many as the prefix filter needs.

    grp is the digest of the prefix. With `rest`, the other shingles stand in the place of the prefix, as column rest.
    With `members`, a broadcast Bloom filter, texts of other ids are left out.
    """

    def sign(part):
        rank = sketch.value
        for piece, sets in _sets_of(part if members is None else (_among(batch, members.value) for batch in part), words_each):
            n, digest, grp, parity, shown = [], [], [], [], []
            for x in sets:
                n.append(len(x))
                parity.append(parities(x))
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                most = len(x) - (percent * len(x) + 99) // 100 + 1 if len(x) else 0
                key = rank[(x >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(44) | x >> np.uint64(20)
                order = np.argsort(key, kind="stable")
                prefix = x[order[:most]].view(np.int64)
                grp.append(hashlib.blake2b(prefix.tobytes(), digest_size=16).digest())
                shown.append(x[order[most:]].view(np.int64) if rest else prefix)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": piece["id"], "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "grp": pa.array(grp, pa.binary()),
                    "parity": pa.array(parity, pa.list_(pa.int64())), name: pa.array(shown, pa.list_(pa.int64())),
                }
            )

    name = "rest" if rest else "prefix"
    return texts.mapInArrow(sign, f"id long, n long, digest binary, grp binary, parity array<long>, {name} array<long>")


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    k = keys.view(np.uint64)
    return [(mix(k + np.uint64(j)) >> np.uint64(64 - bits)).astype(np.int64) for j in (1, 2)]


def bloom_filter(keys: DataFrame, bits: int = 24) -> np.ndarray:
    """A Bloom filter of 2 ** bits bits (2 MB for 24) over the one long column of keys: fixed size, however many keys."""
    (name,) = keys.columns

    def mark(part):
        for batch in part:
            at = np.unique(np.concatenate(_places(batch[name].to_numpy(), bits)))
            words, starts = np.unique(at >> 6, return_index=True)
            marks = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), starts) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(marks.view(np.int64))], ["word", "marks"])

    got = keys.mapInArrow(mark, "word int, marks long").groupBy("word").agg(F.bit_or("marks").alias("marks")).toArrow()  # 2 ** (bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["word"].to_numpy()] = got["marks"].to_numpy().view(np.uint64)
    return out


def maybe_in(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key is surely not in the filter."""
    bits = int(len(bloom)).bit_length() + 5
    out = np.ones(len(keys), bool)
    for at in _places(np.ascontiguousarray(keys), bits):
        out &= (bloom[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return out


def _among(batch: pa.RecordBatch, bloom: np.ndarray) -> pa.RecordBatch:
    """The rows whose id may be in the filter."""
    return batch.filter(pa.array(maybe_in(bloom, batch["id"].fill_null(0).to_numpy()) & batch["id"].is_valid().to_numpy(zero_copy_only=False)))


def pairs_within_groups(members: DataFrame, texts: DataFrame, sketch, words_each: int, percent: int, bits: int) -> DataFrame:
    """(a, b): the pairs of one group (n, grp) and different components that can reach the similarity.

    members: (id, n, digest, grp, component) of classes. All of a group have n shingles and share
    the prefix, so a pair that holds has overlap - prefix of the others in common too. These are
    ordered by how many members have them, and the first n - overlap + 1 of them meet: a second
    prefix filter inside the group, so members meet by what few of them share.
    """
    bloom = texts.sparkSession.sparkContext.broadcast(bloom_filter(members.select("id").distinct()))

    some = _signatures(texts, sketch, words_each, percent, bits, rest=True, members=bloom).drop("parity")
    some = some.join(members, ["id", "n", "digest", "grp"]).dropDuplicates(["id", "n", "digest"])
    key = ["n", "grp", "token"]
    tokens = materialize(some.select("id", "n", "digest", "grp", "component", F.size("rest").alias("others"), F.explode("rest").alias("token")))
    counts = tokens.groupBy(key).agg(F.count("*").alias("c")).where("c > 1")
    own = tokens.join(counts, key).groupBy("id", "n", "digest", "grp", "component", "others").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("x"))
    overlap = f"(2 * {percent} * n + {99 + percent}) div {100 + percent}"
    meet = F.expr(f"slice(x, 1, cast(greatest(0, n - {overlap} + 1 - (others - size(x))) as int))")  # shingles of one member come first and meet none
    dealt = materialize(own.select("id", "n", "grp", "component", F.explode(meet).alias("m")).select("id", "n", "grp", "component", F.col("m.token").alias("token")))
    u, v = dealt.alias("u"), dealt.alias("v")
    return u.join(v, F.expr("u.n = v.n and u.grp = v.grp and u.token = v.token and u.component != v.component and u.id < v.id")).select(F.col("u.id").alias("a"), F.col("v.id").alias("b"))


def possible_links(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities don't rule the similarity out; none that reaches it is lost.

    Linked sets of n and m shingles differ by (n + m) * (100 - percent) / (100 + percent) at most,
    and their parities by no more.
    """
    side = lambda i, n, x: signed.where("n > 0").select(F.col("id").alias(i), F.col("n").alias(n), F.col("parity").alias(x))
    both = pairs.select("a", "b").join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
    apart = reduce(add, [F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k])) for k in range(PARITY_WORDS)])
    return both.where(apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)).select("a", "b").distinct()


def verified_links(pairs: DataFrame, signed: DataFrame, texts: DataFrame, words_each: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact sets reach the similarity, from the texts of these ids alone.

    Parities sort out most others before any text moves. A Bloom filter of fixed size keeps other
    texts from being shuffled; texts travel compressed.
    """
    pairs = materialize(possible_links(pairs, signed, percent))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    bloom = texts.sparkSession.sparkContext.broadcast(bloom_filter(ids))

    def collect(part):
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in part:
            some = _among(batch, bloom.value)
            yield pa.RecordBatch.from_arrays([some["id"], pa.array([zip_.compress((x or "").encode()) for x in some["text"].to_pylist()], pa.binary())], ["id", "packed"])

    some = materialize(texts.mapInArrow(collect, "id long, packed binary"), "lz4")

    def compare(part):
        unzip = zstandard.ZstdDecompressor()
        for batch in part:
            keep = []
            size = np.cumsum([0, *(zstandard.frame_content_size(x) + zstandard.frame_content_size(y) for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True))])
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(size, size[at] + (1 << 20), side="right")) - 1)
                piece, at = batch.slice(at, stop - at), stop
                both = [shingle_sets(pa.array([unzip.decompress(x).decode() for x in piece[c].to_pylist()], pa.string()), words_each) for c in ("x", "y")]
                for x, y in zip(*both, strict=True):
                    every = np.sort(np.concatenate([x, y]))
                    same = int((every[1:] == every[:-1]).sum())
                    keep.append(100 * same >= percent * (len(x) + len(y) - same) and len(x) > 0)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
            give_back()

    x, y = some.select(F.col("id").alias("a"), F.col("packed").alias("x")), some.select(F.col("id").alias("b"), F.col("packed").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def jaccard_components(
    documents: DataFrame, words_each: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = 20
) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row: links join texts with 100 * intersection >= percent * union.

    1. Equal sets collapse to one class, named by its least id.
    2. Classes with one prefix and size form a group; rare shingles come first in a prefix, so a
       passage that many texts share is in few prefixes. Prefix shingles of one group alone find
       nothing in other groups and are left out before postings are dealt.
    3. Hub round: members are paired with the least of their group, and groups with the least
       group of each prefix shingle and size band, also of the band below. Pairs are as many as
       postings, however large a group of copies is.
    4. Links that hold are joined to components. A shingle or group whose texts are all in one
       component has nothing left to find. For the other shingles, groups are expanded and every
       pair of classes in different components that passes the size and position filters is
       verified; members of one other group meet by the shingles after their prefix, since
       postings lack the prefix shingles of that group alone. No link is lost.

    Null and empty texts have 0 shingles and link with nothing. A null id has a null component.
    Rows that share an id are one node of the graph. Shingles are compared by 64-bit hashes.
    Shuffle files of a step are deleted when it has ended.
    """
    texts = bounded_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with clean_shuffles(texts.sparkSession):
        signed, components = _signed_components(texts, words_each, percent, sketch_bits)
    out = signed.select("id", "n").join(components.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _signed_components(texts: DataFrame, words_each: int, percent: int, sketch_bits: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all texts (id, text), and the components (node, component) of linked ones."""
    sketch = texts.sparkSession.sparkContext.broadcast(shingle_sketch(texts, words_each, sketch_bits))
    signed = materialize(_signatures(texts, sketch, words_each, percent, sketch_bits))
    slim = signed.where("n > 0 and id is not null").select("id", "n", "digest", "grp")
    classes = slim.groupBy("n", "digest", "grp").agg(F.min("id").alias("rep"))
    groups = classes.groupBy("n", "grp").agg(F.min("rep").alias("hub"))
    classes = materialize(classes.join(groups, ["n", "grp"]))
    copies = slim.join(classes, ["n", "digest", "grp"]).where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    hubs = classes.where("rep = hub").select(F.col("hub").alias("id"), "n", "digest")
    own = materialize(signed.join(hubs, ["id", "n", "digest"], "left_semi").select(F.col("id").alias("hub"), "n", "prefix"))
    shared = materialize(own.select("hub", "n", F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token"))
    bloom = texts.sparkSession.sparkContext.broadcast(bloom_filter(shared))

    def spread(part):
        for batch in part:
            lengths = batch["prefix"].value_lengths().to_numpy()
            token = batch["prefix"].flatten().to_numpy()
            row = np.repeat(np.arange(len(lengths)), lengths)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = maybe_in(bloom.value, token)
            at = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch["hub"].take(at), batch["n"].take(at), pa.array(token[keep]), pa.array(pos[keep].astype(np.int32))], ["hub", "n", "token", "pos"])

    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(percent / 100) / 2)).cast("int")
    postings = own.mapInArrow(spread, "hub long, n long, token long, pos int").join(shared, "token").withColumn("band", band)
    postings = materialize(postings)
    first = postings.groupBy("token", "band").agg(F.min(F.struct("hub", "n")).alias("f"))
    first = first.select("token", "band", F.col("f.hub").alias("other"), F.col("f.n").alias("m"))
    near = postings.join(first.unionByName(first.withColumn("band", F.col("band") + 1)), ["token", "band"])
    near = near.where(f"hub != other and 100 * least(n, m) >= {percent} * greatest(n, m)").select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"))
    pairs = materialize(classes.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).union(near).distinct())
    links = materialize(verified_links(pairs, signed, texts, words_each, percent))
    components = connected_components(links.union(copies))

    # what the hubs left open: shingles with classes of different components, their groups expanded
    member = classes.select("hub", F.col("rep").alias("id")).join(components.withColumnRenamed("node", "id"), "id", "left")
    member = materialize(member.select("hub", "id", F.coalesce("component", "id").alias("component")))
    span = member.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = postings.select("token", "hub").join(span, "hub").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("token")
    left = materialize(postings.select("token", "hub", "n", "pos").join(mixed, "token", "left_semi").join(member, "hub"))
    u, v = left.alias("u"), left.alias("v")
    open_pairs = u.join(
        v,
        F.expr(
            f"u.token = v.token and u.component != v.component and (u.n < v.n or u.n = v.n and u.id < v.id) and 100 * u.n >= {percent} * v.n"
            f" and (100 + {percent}) * least(u.n - u.pos, v.n - v.pos) >= {percent} * (u.n + v.n)"
        ),
    ).select(F.least("u.id", "v.id").alias("a"), F.greatest("u.id", "v.id").alias("b"))
    within = classes.join(span.where("lo != hi").select("hub"), "hub", "left_semi").select(F.col("rep").alias("id"), "n", "digest", "grp")
    within = materialize(within.join(member.select("id", "component").distinct(), "id"))
    if not within.isEmpty():
        open_pairs = open_pairs.union(pairs_within_groups(within, texts, sketch, words_each, percent, sketch_bits))
    open_pairs = materialize(open_pairs.distinct().join(pairs, ["a", "b"], "left_anti"))
    if not open_pairs.isEmpty():
        more = verified_links(open_pairs, signed, texts, words_each, percent)
        at = member.select("id", "component")
        between = more.join(at.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(at.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
        joined = connected_components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
        alone = joined.select(F.col("node").alias("node"), F.col("component"))
        merged = components.join(joined.select(F.col("node").alias("component"), F.col("component").alias("target")), "component", "left")
        merged = merged.select("node", F.coalesce("target", "component").alias("component"))
        components = merged.unionByName(alone.join(components, "node", "left_anti"))
    return signed, components
