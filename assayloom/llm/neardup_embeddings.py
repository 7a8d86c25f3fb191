"""Near-duplicate vectors by collision counting over sorted one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, chain, materialize
from .components import connected_components


def window_width(least_cosine: float, widen: float) -> float:
    """Half the window: the distance of unit vectors at the threshold, times widen."""
    return widen * math.sqrt(2 - 2 * least_cosine)


def needed_collisions(projections: int, widen: float, recall: float) -> int:
    """The highest count that a pair exactly at the threshold reaches with probability recall.

    Along a Gaussian direction such a pair differs by N(0, d), so one window catches it with
    probability erf(widen / sqrt 2), and the number of windows that do is binomial.
    """
    p, least, tail = math.erf(widen / math.sqrt(2)), projections, 0.0
    while least > 0:
        tail += math.comb(projections, least) * p**least * (1 - p) ** (projections - least)
        if tail >= recall:
            break
        least -= 1
    return least


#: Width of a cell on a line; projections of unit vectors spread by 1.
CELL = 1.5


def same_cell(spread: float) -> float:
    """The probability that two points whose projections differ by N(0, spread) share a cell, whose offset is random."""
    x = CELL / spread
    return math.erf(x / math.sqrt(2)) - 2 * spread / (math.sqrt(2 * math.pi) * CELL) * (1 - math.exp(-x * x / 2))


def index_size(n: int, least_cosine: float, bucket: int, recall: float) -> tuple[int, int]:
    """(lines, tables) for a block of n classes: cells of so many sorted lines at once hold about `bucket` unrelated classes,
    and a pair exactly at the threshold meets in one of so many tables with probability recall. A smaller block is one cell."""
    if n <= bucket:
        return 0, 1
    lines = math.ceil(math.log(n / bucket) / -math.log(same_cell(math.sqrt(2))))
    met = same_cell(math.sqrt(2 - 2 * least_cosine)) ** lines
    return lines, math.ceil(math.log(1 - recall) / math.log(1 - met))


def _units(vectors, dim: int) -> np.ndarray:
    """Rows of unit length; scaled first, which keeps the norm of huge and tiny vectors finite."""
    chunks = vectors.chunks if isinstance(vectors, pa.ChunkedArray) else [vectors]
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in chunks)])
    unit = flat.reshape(-1, dim)
    unit = unit / np.abs(unit).max(1, keepdims=True, initial=1e-300)
    return unit / np.sqrt((unit * unit).sum(1, keepdims=True))


def _cells(unit: np.ndarray, lines: int, tables: int, seed: int) -> np.ndarray:
    """The cell of each row in each table, as one number."""
    out = np.zeros((len(unit), tables), np.uint64)
    for t in range(tables if lines else 0):
        rng = np.random.default_rng((seed, t))
        offset = rng.uniform(0, CELL, 64)
        at = np.floor((unit @ np.stack([rng.standard_normal(unit.shape[1]) for _ in range(lines)], 1) + offset[:lines]) / CELL).astype(np.int64).view(np.uint64)
        key = np.full(len(unit), np.uint64(t))
        for column in at.T:
            key = chain(key, column)
        out[:, t] = key
    return out.view(np.int64)


def _verified(u, v, pu, pv, width, least, least_cosine):
    """Pairs (i, j) whose windows collide at least `least` times and whose cosine holds."""
    counts = np.zeros((len(u), len(v)), np.int8)
    for k in range(pu.shape[1]):
        order = np.argsort(pv[:, k], kind="stable")
        ranks = np.empty(len(v), np.int16)
        ranks[order] = np.arange(len(v), dtype=np.int16)
        line = pv[order, k]
        low = np.searchsorted(line, pu[:, k] - width, side="left").astype(np.int16)
        high = np.searchsorted(line, pu[:, k] + width, side="right").astype(np.int16)
        counts += (ranks >= low[:, None]) & (ranks < high[:, None])
    i, j = np.nonzero(counts >= least)
    found = [np.zeros(0, bool)]
    for at in range(0, len(i), 65536):
        found.append(np.einsum("ab,ab->a", u[i[at : at + 65536]], v[j[at : at + 65536]]) >= least_cosine)
    found = np.concatenate(found)
    return i[found], j[found]


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_col: str = "label",
    least_cosine: float = 0.93,
    projections: int = 24,
    widen: float = 1.2,
    recall: float = 0.9995,
    bucket: int = 512,
    index_recall: float = 0.998,
    tile: int = 2048,
    seed: int = 11,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; rows link inside one block at cosine >= least_cosine.

    Equal vectors of a block collapse to one class first, so copies cost one row.

    1. Index: lines of random directions are cut into cells, and a class is dealt to its cell of
       several lines at once in each of several tables. Lines and tables follow from the number
       of classes in the block (index_size), so a cell holds about `bucket` classes whatever the
       block holds, and a class is copied to as many cells as there are tables. A cell of more
       than `tile` classes is split, and its tiles meet two at a time.
    2. Count: in a cell, `projections` further lines are sorted and the window around each class's
       value is found by bisection; a pair's collisions are counted over the lines.
    3. Verify: pairs that reach the calibrated count are compared in double precision. A pair that
       meets in several tables counts in the first. A task returns a count and a local root per
       class, never the pairs.

    A pair exactly at the threshold is found with probability index_recall * recall; closer ones
    more surely, equal ones always.

    Rows with a null block or vector, a zero vector, null or non-finite components, or vectors of
    another width link with nothing (n_links 0, own component). A null id keeps a null component
    and is not kept. Every row is a vector of its own: repeated rows, and rows that share an id
    but not their vector, each have their own links. Extra columns are left alone.
    """
    width, least = window_width(least_cosine, widen), needed_collisions(projections, widen, recall)
    rows = bounded_batches(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(block_col).alias("block"), F.col(vector_col).cast("array<double>").alias("vector"))
    x = F.col("vector")
    usable = (
        F.col("id").isNotNull()
        & F.col("block").isNotNull()
        & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    )
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    plain = F.transform(x, lambda v: v + F.lit(0.0))  # -0.0 and 0.0 are one value
    keys = ["block", "dim", "h1", "h2"]
    rows = rows.withColumns({"h1": F.xxhash64(plain), "h2": F.xxhash64(F.lit(seed), F.reverse(plain)), "dim": F.size(x)})
    named = F.xxhash64(*keys).alias("cls")
    classes = materialize(rows.where("usable").groupBy(*keys).agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector")).select("*", named))
    sizes = classes.groupBy("block", "dim").agg(F.count("*").alias("n"))
    of_block = classes.join(sizes, ["block", "dim"]).select("block", "dim", "n", "cls", "size", "vector")

    def deal(part):
        for batch in part:
            dims, n = batch["dim"].to_numpy(), batch["n"].to_numpy()
            for d, m in np.unique(np.stack([dims, n], 1), axis=0):
                some = batch.filter(pa.array((dims == d) & (n == m)))
                lines, tables = index_size(int(m), least_cosine, bucket, index_recall)
                cells = _cells(_units(some["vector"], int(d)), lines, tables, seed)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(cells), pa.list_(pa.int64()))], [*some.schema.names, "cells"])

    schema = T.StructType([*of_block.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])
    indexed = materialize(of_block.mapInArrow(deal, schema).drop("n"))
    cell = ["block", "dim", "table", "cell"]
    slim = indexed.select("block", "dim", "cls", F.posexplode("cells").alias("table", "cell"))
    full = slim.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1").select(*cell, F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    places = slim.join(full, cell).groupBy("cls").agg(F.collect_list(F.struct("table", "cell", "tiles")).alias("places"))  # a row for each table at most
    dealt = indexed.join(places, "cls").select("block", "dim", "cls", "size", "vector", "cells", F.inline("places"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(*cell, "cls", "size", "vector", "cells", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def count_tile(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        dim, table, low, high = key[1].as_py(), key[2].as_py(), key[4].as_py(), key[5].as_py()
        names, size, own = (got[c].to_numpy() for c in ("cls", "size", "own"))
        unit = _units(got["vector"], dim)
        cells = np.concatenate([c.flatten().to_numpy() for c in got["cells"].chunks]).reshape(len(names), -1)[:, :table]
        lines = unit @ np.random.default_rng(seed).standard_normal((dim, projections))
        a = np.flatnonzero(own == low)
        b = a if low == high else np.flatnonzero(own == high)
        links, label = np.zeros(len(names), np.int64), np.arange(len(names))
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(b), 8192):  # ranks are 16 bit
            part = b[s : s + 8192]
            for q in range(0, len(a), 1024):
                some = a[q : q + 1024]
                i, j = _verified(unit[some], unit[part], lines[some], lines[part], width, least, least_cosine)
                i, j = some[i], part[j]
                if low == high:
                    i, j = i[i < j], j[i < j]
                new = ~(cells[i] == cells[j]).any(1)  # not met in an earlier table
                src.append(i[new])
                dst.append(j[new])
        i, j = np.concatenate(src), np.concatenate(dst)
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        while len(i):
            before = label.copy()
            np.minimum.at(label, i, label[j])
            np.minimum.at(label, j, label[i])
            label = label[label]
            if (label == before).all():
                break
        at = np.flatnonzero(links)
        return pa.table({"a": names[at].astype(np.int64), "b": names[label[at]].astype(np.int64), "links": links[at]})

    met = materialize(dealt.groupBy(*cell, "low", "high").applyInArrow(count_tile, "a long, b long, links long"))
    degree = met.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    linked = classes.select("cls", "rep").join(connected_components(met).withColumnRenamed("node", "cls"), "cls")
    roots = linked.groupBy("component").agg(F.min("rep").alias("root"))
    found = classes.select("cls", "rep", "size").join(degree, "cls", "left").join(linked.join(roots, "component").select("cls", "root"), "cls", "left")
    out = rows.select("id", "usable", F.when(F.col("usable"), named).alias("cls")).join(found, "cls", "left")
    own = F.when(F.col("usable"), F.coalesce("root", "rep")).otherwise(F.col("id"))
    n = F.when(F.col("usable"), F.col("size") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0))
    return out.select(F.col("id").alias(id_col), n.cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def brute_force(pdf: pd.DataFrame, least_cosine: float = 0.93) -> pd.DataFrame:
    """The same result for a small table, from all cosines; for tests."""
    ok = [v is not None and r == r and r is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for v, r in zip(pdf["embedding"], pdf["label"], strict=True)]
    n, comp = np.zeros(len(pdf), int), list(pdf["vec_id"])
    at = np.flatnonzero(ok)
    unit = [np.array(pdf["embedding"].iloc[i], float) for i in at]
    unit = [u / np.linalg.norm(u) for u in unit]
    edges = [(i, j) for x, i in enumerate(at) for y, j in enumerate(at) if x < y and pdf["label"].iloc[i] == pdf["label"].iloc[j] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= least_cosine]
    for i, j in edges:
        n[i] += 1
        n[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    return pd.DataFrame({"vec_id": pdf["vec_id"], "n_links": n, "component_id": comp, "kept": [a == b for a, b in zip(pdf["vec_id"], comp, strict=True)]})
