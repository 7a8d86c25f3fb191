"""A content-addressed store of token ids: rolling-hash chunks stored once, recipes and Merkle manifests."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, bounded_batches, mix, objects, scratch_dir
from .encoding import encoder

WINDOW = 16
SHORTEST, LONGEST = 64, 4096
#: One position in this many is a cut, on average.
MEAN = 512
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Inverse of ODD modulo 2 ** 64.
UNODD = np.uint64(pow(int(ODD), -1, 1 << 64))


def cut_points(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin, over all texts: starts[i]:starts[i + 1] are the ids of text i.

    A cut follows the position where a polynomial hash of the last WINDOW ids, all of this text,
    falls in one of MEAN cases; positions within SHORTEST of an earlier such position do not
    count, and longer runs than LONGEST are cut evenly from their start. Equal passages
    so get equal chunks wherever they stand.
    """
    n = len(ids)
    up = np.cumprod(np.full(n, ODD, np.uint64)) if n else np.zeros(0, np.uint64)
    down = np.cumprod(np.full(n, UNODD, np.uint64)) if n else up
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(ids.astype(np.uint64) + ODD) * up)])
    hits = np.zeros(0, np.int64)
    if n >= WINDOW:
        rolled = mix((total[WINDOW:] - total[:-WINDOW]) * down[WINDOW - 1 :])
        hits = np.flatnonzero(rolled % np.uint64(MEAN) == 0) + WINDOW  # the next chunk begins here
        text = np.searchsorted(starts, hits - 1, side="right") - 1
        inside = (hits - WINDOW >= starts[text]) & (hits < starts[text + 1]) & (hits - starts[text] >= SHORTEST)
        hits = hits[inside]
        hits = hits[np.diff(hits, prepend=-SHORTEST) >= SHORTEST]
    cuts = np.unique(np.concatenate([starts[:-1][np.diff(starts) > 0], hits]))
    gaps = np.diff(np.append(cuts, n))
    long = np.flatnonzero(gaps > LONGEST)
    more = [np.arange(cuts[k] + LONGEST, cuts[k] + gaps[k], LONGEST) for k in long]
    return np.sort(np.concatenate([cuts, *more])).astype(np.int64)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root over digests in order; an odd one rises unchanged; no leaf gives the digest of nothing."""
    level = list(leaves)
    if not level:
        return digest(b"")
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


#: Bits of the CRC-32 polynomial, lowest power at the highest bit, as in zlib.
CRC_POLYNOMIAL = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials modulo CRC_POLYNOMIAL."""
    a, out = a.astype(np.uint32), np.zeros(len(a), np.uint32)
    b = b.astype(np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ CRC_POLYNOMIAL, b >> np.uint32(1))
    return out


def crc_moved(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What the crc of a piece adds (by xor) to the crc of the whole when `after` bytes follow it."""
    out, square, left = crc.astype(np.uint32), np.full(1, 1 << 23, np.uint32), after.astype(np.int64).copy()  # x ** 8
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _times(out[odd], np.broadcast_to(square, int(odd.sum())))
        square, left = _times(square, square), left >> 1
    return out


RECIPE = "id long, row long, local_start long, n_tokens long, width int, lengths array<int>, digests array<binary>, root binary"


def write_token_store(documents: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1 << 20) -> None:
    """Encode every whole text and write the store below path.

    chunks/   digest, ids: each distinct chunk once, ids little-endian, 16 bits wide if the vocabulary allows, else 32.
    recipes/  the documents in ascending id order (nulls first; part, then row): chunk digests and lengths, Merkle root.
    manifest/ a row for each part of recipes: documents, ids, Merkle root over its documents.

    Null and empty texts have the end id alone, or nothing. Repeated ids keep all their rows.
    Tasks drop chunks that they have seen before anything is shuffled, so a chunk shared by many
    documents crosses the network once a task at most. A task encodes block_bytes of text at once
    (or one text), each distinct word of it once: larger blocks take less time and more memory.
    """
    texts = bounded_batches(documents).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = encoder(tokenizer_path).tokenizer.get_vocab_size()
    kind = np.dtype("<u2") if max(size, (end_id or 0) + 1) <= 65536 else np.dtype("<u4")
    end = np.zeros(0, kind) if end_id is None else np.array([end_id], kind)

    def encode(part):
        enc, seen = encoder(tokenizer_path), set()
        for batch in part:
            for at, count in batches(batch["text"], block_bytes):
                piece = batch.slice(at, count)
                ids, starts = enc.texts(piece["text"])
                ids = np.insert(ids.astype(kind), np.repeat(starts[1:], len(end)), np.tile(end, count))
                starts = starts + np.arange(count + 1) * len(end)
                cuts = cut_points(ids, starts)
                ends = np.append(cuts, len(ids))[1:]
                raw, w = ids.tobytes(), kind.itemsize
                names = [digest(raw[a * w : b * w]) for a, b in zip(cuts, ends)]
                firsts = np.searchsorted(cuts, starts)
                lengths = ends - cuts
                lists = [names[a:b] for a, b in zip(firsts, firsts[1:])]
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array(["recipe"] * count),
                        "digest": pa.array([digest(str(x).encode()) for x in piece["id"].to_pylist()]),
                        "ids": pa.nulls(count, pa.binary()),
                        "id": piece["id"],
                        "n_tokens": pa.array(np.diff(starts)),
                        "lengths": pa.array([lengths[a:b] for a, b in zip(firsts, firsts[1:])], pa.list_(pa.int32())),
                        "digests": pa.array(lists, pa.list_(pa.binary())),
                        "root": pa.array([merkle_root(x) for x in lists]),
                    }
                )
                new = {}
                for name, a, b in zip(names, cuts, ends):
                    if name not in seen:
                        seen.add(name)
                        new[name] = raw[a * w : b * w]
                k = len(new)
                yield pa.RecordBatch.from_pydict(
                    {
                        "kind": pa.array(["chunk"] * k, pa.string()),
                        "digest": pa.array(list(new), pa.binary()),
                        "ids": pa.array(list(new.values()), pa.binary()),
                        "id": pa.nulls(k, pa.int64()),
                        "n_tokens": pa.nulls(k, pa.int64()),
                        "lengths": pa.nulls(k, pa.list_(pa.int32())),
                        "digests": pa.nulls(k, pa.list_(pa.binary())),
                        "root": pa.nulls(k, pa.binary()),
                    }
                )

    def once(part):
        seen = set()
        for batch in part:
            keep = []
            for k, name in zip(objects(batch["kind"]), objects(batch["digest"]), strict=True):
                keep.append(k == "recipe" or name not in seen)
                if k == "chunk":
                    seen.add(name)
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = "kind string, digest binary, ids binary, id long, n_tokens long, lengths array<int>, digests array<binary>, root binary"
    dealt = texts.mapInArrow(encode, schema).repartition(F.col("digest")).mapInArrow(once, schema)
    dealt.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/raw")

    def number(part):
        row = start = 0
        for batch in part:
            n = batch["n_tokens"].to_numpy()
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([TaskContext.get().partitionId()] * len(n), pa.int32()),
                    "row": pa.array(np.arange(row, row + len(n))),
                    "local_start": pa.array(start + np.cumsum(n) - n),
                    "width": pa.array([kind.itemsize] * len(n), pa.int32()),
                    **{c: batch[c] for c in ("id", "n_tokens", "lengths", "digests", "root")},
                }
            )
            row, start = row + len(n), start + int(n.sum())

    spark = documents.sparkSession
    order = [F.col("id").asc_nulls_first(), F.col("root")]
    raw = spark.read.schema(schema).parquet(f"{path}/raw").where("kind = 'recipe'").select("id", "n_tokens", "lengths", "digests", "root")
    sorted_rows = raw.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.mapInArrow(number, "part int, row long, local_start long, width int, id long, n_tokens long, lengths array<int>, digests array<binary>, root binary").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/recipes")

    def summarise(part):
        per: dict[int, list] = {}
        for batch in part:
            for p, n, root in zip(batch["part"].to_pylist(), batch["n_tokens"].to_pylist(), batch["root"].to_pylist(), strict=True):
                got = per.setdefault(p, [0, 0, hashlib.blake2b(digest_size=16)])
                got[0], got[1] = got[0] + 1, got[1] + n
                got[2].update(root)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array(list(per), pa.int32()), "documents": pa.array([x[0] for x in per.values()], pa.int64()), "tokens": pa.array([x[1] for x in per.values()], pa.int64()), "root": pa.array([x[2].digest() for x in per.values()], pa.binary())}
        )

    _recipes(spark, path).select("part", "row", "n_tokens", "root").repartition(F.col("part")).sortWithinPartitions("part", "row").mapInArrow(
        summarise, "part int, documents long, tokens long, root binary"
    ).coalesce(1).write.parquet(f"{path}/manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPE + ", part int").parquet(f"{path}/recipes")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, ids binary, kind string").parquet(f"{path}/raw").where("kind = 'chunk'").select("digest", "ids")


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone, with everything verified.

    Each stored chunk is read, held against its digest, and gives the crc of its ids as 32-bit
    numbers; a document's crc is put together from those of its chunks (crc is linear), so no ids
    are shuffled. The read fails if a chunk is damaged or missing, or a root or manifest differs.
    """

    def check(part):
        for batch in part:
            names, crc, n = objects(batch["digest"]), [], []
            width = batch["width"].to_numpy()
            for name, data, w in zip(names, objects(batch["ids"]), width, strict=True):
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} does not match its digest")
                ids = np.frombuffer(data, f"<u{w}").astype("<u4")
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
            yield pa.RecordBatch.from_pydict({"digest": batch["digest"], "crc": pa.array(crc, pa.int64()), "n": pa.array(n, pa.int32())})

    def spell(part):
        for batch in part:
            if not batch.num_rows:
                continue
            each = batch["digests"].value_lengths().to_numpy()
            names, last = objects(batch["digests"].flatten()), np.cumsum(each)
            for end, size, root in zip(last.tolist(), each.tolist(), objects(batch["root"]), strict=True):
                if merkle_root(names[end - size : end]) != root:
                    raise ValueError("a recipe does not match its root")
            n = batch["lengths"].flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(each)), each)
            ends = np.cumsum(n)
            last = np.concatenate([[0], ends])[last]
            cols = {c: batch[c].take(pa.array(doc)) for c in ("part", "row")}
            yield pa.RecordBatch.from_pydict(cols | {"digest": batch["digests"].flatten(), "length": pa.array(n.astype(np.int32)), "after": pa.array(4 * (last[doc] - ends))})

    def move(part):
        for batch in part:
            moved = crc_moved(batch["crc"].to_numpy().astype(np.uint32), batch["after"].to_numpy())
            yield pa.RecordBatch.from_arrays([batch["part"], batch["row"], batch["n"], pa.array(moved.astype(np.int64))], ["part", "row", "n", "moved"])

    recipes = _recipes(spark, path)
    width = recipes.select("width").first()
    chunks = _chunks(spark, path).select("digest", "ids", F.lit(width[0] if width else 2).alias("width")).mapInArrow(check, "digest binary, crc long, n int")
    used = recipes.select("part", "row", "digests", "lengths", "root").mapInArrow(spell, "part int, row long, digest binary, length int, after long")
    met = used.join(chunks, "digest").where("n = length").select("part", "row", "crc", "after", "n")
    crcs = met.mapInArrow(move, "part int, row long, n int, moved long").groupBy("part", "row").agg(F.bit_xor("moved").alias("crc"), F.sum("n").alias("total"), F.count("*").alias("pieces"))
    before = F.sum("tokens").over(_by_part()) - F.col("tokens")
    parts = spark.read.schema("part int, documents long, tokens long, root binary").parquet(f"{path}/manifest").select("part", before.alias("base"))
    out = recipes.select("part", "row", "id", "local_start", "n_tokens", F.size("digests").alias("parts")).join(crcs, ["part", "row"], "left").join(F.broadcast(parts), "part")
    whole = (F.coalesce("pieces", F.lit(0)) == F.col("parts")) & (F.coalesce("total", F.lit(0)) == F.col("n_tokens"))
    crc = F.when(whole, F.coalesce("crc", F.lit(0))).otherwise(F.raise_error(F.lit("a chunk is missing or has another length")).cast("long"))
    return out.select("id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", crc.alias("ids_crc32"))


def _by_part():
    from pyspark.sql import Window

    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each part


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id, part, row, ids): every document's ids put together again from the store."""
    recipes = _recipes(spark, path).select("part", "row", "id", "width", F.posexplode_outer("digests").alias("seq", "digest"))
    met = recipes.join(_chunks(spark, path), "digest", "left").groupBy("part", "row", "id", "width").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("x"))

    def spell(part):
        for batch in part:
            ids = [np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(p["ids"] or b"", f"<u{w}") for p in x)]).astype(np.int64) for x, w in zip(batch["x"].to_pylist(), batch["width"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "part": batch["part"], "row": batch["row"], "ids": pa.array(ids, pa.list_(pa.int32()))})

    return met.mapInArrow(spell, "id long, part int, row long, ids array<int>")


def token_digests(documents: DataFrame, tokenizer_path: str, end_id: int | None = 1, block_bytes: int = 1 << 20) -> DataFrame:
    """Write documents to a store in the shared scratch folder and read their digests back.

    (id, start, n_tokens, ids_crc32) for every row, repeats included; an empty table gives none, null
    ids come first, null and empty texts have the end id alone. Only doc_id and text are read.
    """
    spark = documents.sparkSession
    path = scratch_dir(spark)
    write_token_store(documents, path, tokenizer_path, end_id, block_bytes=block_bytes)
    return read_token_digests(spark, path)
