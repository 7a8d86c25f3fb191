"""Helpers that several of the operators share: tables, scratch tables, words, hashes."""

from __future__ import annotations

import re
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.scratch import discard, materialize, scratch_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of an Arrow batch between JVM and Python.
BATCH_BYTES = 8 << 20


def bounded_batches(frame: DataFrame) -> DataFrame:
    """frame, whose session from now on sends Arrow batches of at most BATCH_BYTES: texts differ in length, and rows alone bound no memory."""
    conf, name = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(name))) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return frame


#: Whether Spark deletes the shuffle files of a finished execution at once, not at the driver's next collection of garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def clean_shuffles(spark: SparkSession):
    """Inside, the shuffle files of each execution are deleted when it has ended, so those of several steps don't add up."""
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def materialize_clean(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """As materialize; the shuffle files of the write are deleted when it has ended, so those of several large steps don't add up."""
    with clean_shuffles(df.sparkSession):
        return materialize(df, codec)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, seed: int) -> DataFrame:
    """(doc_id, text, y, turn): texts of at most `rows` labelled ids for which `learn` holds, drawn by a seeded hash.

    A doc_id with several labels takes the largest; null labels and null ids teach nothing. The ids
    are drawn from the label table alone; they are at most `rows`, so their broadcast is bounded.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(learn, F.lit(False)))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    drawn = known.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id")).orderBy("turn", "doc_id").limit(rows)
    return documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def objects(values: pa.Array) -> list:
    """As to_pylist, for strings, binaries and numbers without nulls, at a seventh of its time."""
    return values.to_numpy(zero_copy_only=False).tolist()


def batches(texts: pa.Array, most_bytes: int = 1 << 20):
    """Slices (start, length) of a text column that hold at most most_bytes, or one row."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield at, stop - at
        at = stop
    pa.default_memory_pool().release_unused()  # workers live on after a task


def string_hashes(strings: pa.Array) -> np.ndarray:
    """A fixed 64-bit hash of each string, equal on every machine."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False), categorize=False)


class Words:
    """Words of a column of texts: white space `[\\x20\\x09-\\x0D]` parts them, A-Z become a-z (or not).

    starts[i]:starts[i + 1] are the words of text i; ids point into vocabulary.
    Null and empty texts have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = texts.cast(pa.string()).fill_null("")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False).astype(bool)
        if not full.all():
            offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.starts = offsets
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocabulary = coded.dictionary
        self.counts = np.diff(offsets)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """The hash of each word, in the order of the text."""
        return string_hashes(self.vocabulary)[self.ids]


MIX_A, MIX_B, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, which spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def chain(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The hash of a sequence that goes on with one more element; order matters."""
    return mix(first * np.uint64(3) + then + STEP)
