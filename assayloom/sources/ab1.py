"""Chromatogram files (ABIF) through Spark's binaryFile source."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of the element types that are decoded, with their struct codes.
ELEMENTS = {1: "B", 3: "H", 4: "h", 5: "i"}
CHAR = 2
#: Bytes of a directory entry, and where the values of a file that is written here begin.
ENTRY, HEADER = 28, 128
CHANNELS = ("DATA9", "DATA10", "DATA11", "DATA12")
PARSED = "ord bigint, filename string, raw_seq string, raw_qual array<int>, trace map<string,array<int>>, ploc array<int>, error string"


def parse_abif(data: bytes) -> dict[tuple[str, int], object]:
    """The directory entries of an ABIF file by tag name and number: numbers as lists, all else as bytes.

    A directory that claims more entries than the file holds ends with the file.
    """
    if len(data) < 34 or data[:4] != b"ABIF":
        raise ValueError("not an ABIF file")
    count, _, offset = struct.unpack_from(">iii", data, 18)
    found: dict[tuple[str, int], object] = {}
    for at in range(offset, min(offset + ENTRY * count, len(data) - ENTRY + 1), ENTRY):
        name, number, kind, _, n, size, _ = struct.unpack_from(">4sihhiii", data, at)
        begin = at + 20 if size <= 4 else struct.unpack_from(">i", data, at + 20)[0]
        body = data[begin : begin + size]
        found[name.decode("ascii", "replace"), number] = list(struct.unpack_from(f">{n}{ELEMENTS[kind]}", body)) if kind in ELEMENTS else body
    return found


def encode_abif(bases: str, qualities: list[int] | None = None, trace: dict[str, list[int]] | None = None, places: list[int] | None = None) -> bytes:
    """An ABIF file with called bases and, where they are given, qualities, traces by channel name, and base positions."""
    short = lambda values: struct.pack(f">{len(values)}h", *values)
    tags = [("PBAS", 2, CHAR, 1, bases.encode("ascii"))]
    tags += [("PCON", 2, CHAR, 1, bytes(qualities))] if qualities is not None else []
    tags += [("PLOC", 2, 4, 2, short(places))] if places is not None else []
    tags += [(c[:4], int(c[4:]), 4, 2, short(values)) for c, values in sorted((trace or {}).items())]
    body, entries = b"", b""
    for name, number, kind, width, value in tags:
        inside = len(value) <= 4
        where = value.ljust(4, b"\0") if inside else struct.pack(">i", HEADER + len(body))
        entries += struct.pack(">4sihhii4si", name.encode(), number, kind, width, len(value) // width, len(value), where, 0)
        body += b"" if inside else value
    head = struct.pack(">4sh4sihhiiii", b"ABIF", 101, b"tdir", 1, 1023, ENTRY, len(tags), ENTRY * len(tags), HEADER + len(body), 0)
    return head.ljust(HEADER, b"\0") + body + entries


def _numbers(value: object) -> list[int]:
    return list(value or [])


def read_fields(data: bytes) -> dict:
    """Bases, qualities, base positions and the four traces of one chromatogram; fails without called bases."""
    tags = parse_abif(data)
    bases = tags.get(("PBAS", 2))
    if bases is None:
        raise ValueError("no called bases (PBAS2)")
    text = bytes(bases).decode("ascii", "replace")
    trace = {c: _numbers(tags[c[:4], int(c[4:])]) for c in CHANNELS if (c[:4], int(c[4:])) in tags}
    ploc = tags.get(("PLOC", 2)) or tags.get(("PLOC", 1))
    return {"raw_seq": text.upper(), "raw_qual": _numbers(tags.get(("PCON", 2))), "trace": trace, "ploc": _numbers(ploc)}


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for number, name, data in zip(frame["ord"], frame["filename"], frame["data"], strict=True):
            try:
                rows.append({"ord": number, "filename": name, **read_fields(bytes(data)), "error": None})
            except (ValueError, struct.error, IndexError) as wrong:
                rows.append({"ord": number, "filename": name, "raw_seq": None, "raw_qual": None, "trace": None, "ploc": None, "error": f"{name} : {wrong}"})
        yield pd.DataFrame(rows, columns=["ord", "filename", "raw_seq", "raw_qual", "trace", "ploc", "error"])


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def clone_id(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def load_files(files: DataFrame) -> DataFrame:
    """files (ord, filename, data) -> reads with their identity and measures, and `error` where a file can't be read."""
    return with_measures(files.select("ord", "filename", "data").mapInPandas(_parse, PARSED))


def with_measures(reads: DataFrame) -> DataFrame:
    """Parsed files (ord, filename, raw_seq, raw_qual, trace, ploc, error) with names and measures."""
    n = F.length("raw_seq")
    mean = F.when(F.size("raw_qual") > 0, F.aggregate("raw_qual", F.lit(0).cast("bigint"), lambda a, x: a + x) / F.size("raw_qual"))
    return reads.select(
        "ord", clone_id(F.col("filename")).alias("id"), clone_id(F.col("filename")).alias("clone"), clone_id(F.col("filename")).alias("stem"),
        F.lit("").alias("date"), F.lit("").alias("batch"), F.lit("").alias("primer"), basename(F.col("filename")).alias("filename"),
        "raw_seq", "raw_qual", "trace", "ploc", n.alias("raw_len"), mean.alias("mean_q"),
        ((F.size("raw_qual") == n) & (n > 0)).alias("has_qual"), ((F.size("trace") == 4) & (F.size("ploc") >= n)).alias("has_trace"), "error",
    )


def read_ab1(spark: SparkSession, path: str, glob: str = "*.ab1") -> DataFrame:
    """All chromatograms below a folder through Spark's own file systems; ord is a hash of the path. A bad file costs its own row only.

    Spark's own source passes over empty files. read_abif reports them and numbers files by path, in stores that pyarrow reaches.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return load_files(files.select(F.xxhash64("path").alias("ord"), F.col("path").alias("filename"), F.col("content").alias("data")))


def split_errors(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good reads, (filename, message) of the others)."""
    return reads.where("error is null").drop("error"), reads.where("error is not null").select("filename", F.col("error").alias("message"))
