"""Product codes of vectors: float32 matrix products screen the codebook entries, int64 settles those that rounding leaves open."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows whose distances are held at once.
BLOCK = 4096
#: Unit roundoff of float32, and how much every bound is widened for the rounding of the bound itself.
ROUNDOFF, WIDER = 2.0**-24, 1.01


def largest_component(dim: int) -> int:
    """Integers beyond this saturate: the error of a whole vector of dim components then fits into int64."""
    return 1 << max(1, int((62 - np.ceil(np.log2(max(dim, 2)))) // 2) - 1)


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, ties to the lower index; both arguments are int64.

    The float32 product x.c of m components, its conversions included, is within g |x| |c| of the
    true one, g = (m + 4) u / (1 - (m + 4) u), in whatever order it is summed. An entry whose
    interval of |c|^2 - 2 x.c begins above the least upper end of any interval can't be nearest;
    all others are computed again in int64, ties among them included.
    """
    m = parts.shape[1]
    g = WIDER * (m + 4) * ROUNDOFF / (1 - (m + 4) * ROUNDOFF)
    squares = (entries.astype(np.float64) ** 2).sum(1)
    lengths = np.sqrt(squares)
    index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), BLOCK):
        x = parts[at : at + BLOCK]
        product = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
        size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        middle = squares - 2 * product
        # the last term covers what float64 rounds in squares and sums
        slack = 2 * g * size[:, None] * lengths + WIDER * 2.0**-50 * (squares + 2 * size[:, None] * lengths)
        row, entry = np.nonzero(middle - slack <= (middle + slack).min(1)[:, None])
        exact = ((x[row] - entries[entry]) ** 2).sum(1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == best[row])
        index[at : at + BLOCK] = entry[hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]]
        error[at : at + BLOCK] = best
    return index, error


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(-1, dim)


def _quantised(vectors: DataFrame, dim: int, scale: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, q): the usable vectors of dim components as integers floor(scale * x)."""
    top = largest_component(dim)

    def quantise(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            column = batch.column("v")
            flat = column.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            good = np.isfinite(x).all(1)
            with np.errstate(over="ignore"):  # beyond float64 is beyond top as well
                q = np.clip(np.floor(x[good] * scale), -top, top).astype(np.int32)
            kept = batch.filter(pa.array(good))
            offsets = pa.array(np.arange(0, len(q) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), pa.ListArray.from_arrays(offsets, pa.array(q.ravel()))], ["id", "label", "q"])

    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(F.size("v") == dim)
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(quantise, f"id {kinds['id']}, label {kinds['label']}, q array<int>")


def encode_rows(kept: DataFrame, codebooks: list[np.ndarray], dim: int) -> DataFrame:
    """(id, label, code, error) of quantised rows under codebooks: one int64 matrix of entries for each part."""
    width = dim // len(codebooks)

    def encode(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in part:
            q = _matrix(batch.column("q"), dim)
            codes, total = np.zeros((len(q), len(codebooks)), np.uint8), np.zeros(len(q), np.int64)
            for p, entries in enumerate(codebooks):
                index, error = nearest_entries(q[:, p * width : (p + 1) * width], entries)
                codes[:, p] = index
                total += error
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(total)], ["id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def refine(kept: DataFrame, codebooks: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry becomes the floored mean of its parts, unused ones stay.

    Each task sends one row of sums for each part and entry, so what is shuffled depends on the
    number of tasks alone; sums are exact decimals.
    """
    width, n = dim // len(codebooks), len(codebooks[0])

    def add(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch has 10,000 rows by default, far fewer than int64 sums of saturated components bear
        for batch in part:
            q = _matrix(batch.column("q"), dim)
            counts, sums = np.zeros((len(codebooks), n), np.int64), np.zeros((len(codebooks), n, width), np.int64)
            for p, entries in enumerate(codebooks):
                x = q[:, p * width : (p + 1) * width]
                index, _ = nearest_entries(x, entries)
                counts[p] = np.bincount(index, minlength=n)
                np.add.at(sums[p], index, x)
            p, e = np.nonzero(counts)
            offsets = pa.array(np.arange(0, len(p) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.ListArray.from_arrays(offsets, pa.array(sums[p, e].ravel()))], ["p", "e", "n", "sums"])

    rows = kept.select("q").mapInArrow(add, "p int, e int, n long, sums array<long>").select("p", "e", "n", F.posexplode("sums").alias("k", "x"))
    found = rows.groupBy("p", "e", "k").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = [c.copy() for c in codebooks]
    for r in found.toArrow().to_pylist():  # one row for each component of the codebooks
        out[r["p"]][r["e"], r["k"]] = int(r["x"]) // r["n"]
    return out


def digest_codebooks(codebooks: list[np.ndarray]) -> str:
    """sha256 of the entries' components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for entries in codebooks for x in entries.ravel().tolist()).encode()).hexdigest()


def product_codes(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """((id_col, label_col, code, error), codebooks): product codes of every usable vector, two hex digits for each part.

    Components become integers floor(scale * x). The codebook of each part begins as that part of
    the `entries` smallest ids (null ids come last, repeats of an id by their components) and goes
    through `rounds` of assignment and floored means. Assignment is exact: see nearest_entries.

    Left out are vectors that are null, empty or hold null or non-finite components, and those
    whose length is not the most common length that `parts` divides (of equally common ones the
    least). Fewer vectors than entries give fewer entries, no vectors no row. Integers beyond
    largest_component saturate. Only the named columns are read, others may have any name.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: entries must be 1 to 256")
    lengths = vectors.select(F.size(vector_col).alias("n")).where((F.col("n") > 0) & (F.col("n") % parts == 0)).groupBy("n").count()
    common = lengths.orderBy(F.desc("count"), "n").limit(1).collect()
    kinds = dict(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dtypes)
    none = vectors.sparkSession.createDataFrame([], f"{id_col} {kinds['id']}, {label_col} {kinds['label']}, code string, error long")
    if not common:
        return none, []
    dim = common[0].n
    kept = materialize(_quantised(vectors, dim, scale, id_col, vector_col, label_col))
    start = kept.orderBy(F.col("id").asc_nulls_last(), "q").limit(entries).select("q").toArrow()["q"].to_pylist()
    if not start:
        return none, []
    width = dim // parts
    codebooks = [np.array([q[p * width : (p + 1) * width] for q in start], np.int64) for p in range(parts)]
    for _ in range(rounds):
        codebooks = refine(kept, codebooks, dim)
    return encode_rows(kept, codebooks, dim).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), codebooks


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """coded with label_error: the error summed over its label, null labels together; sums beyond a long saturate.

    Errors are summed before the shuffle, and one row a label comes back, so no label's rows meet in one task
    as long as Spark finds the sums small enough to broadcast; beyond, AQE splits the rows of a hot label.
    """
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("long")
    sums = coded.groupBy(F.col(label_col).alias("_label")).agg(total.alias("label_error"))
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("_label")), "left").drop("_label")
