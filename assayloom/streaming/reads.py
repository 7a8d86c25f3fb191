"""Chromatograms as they arrive: the stateless part of the analysis over a streaming folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import QcConfig
from ..operators.structure import structural_qc
from ..sources.ab1 import load_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_ab1(spark: SparkSession, path: str) -> DataFrame:
    """Reads of files that appear below path; a bad file has its message in `error`."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.ab1").load(path)
    return load_files(files.select(F.xxhash64("path").alias("ord"), F.col("path").alias("filename"), F.col("content").alias("data")))


def stream_qc(reads: DataFrame, cfg: QcConfig) -> DataFrame:
    """Structural QC of a stream of reads: a row for each read, no state, so append mode works without a watermark."""
    return structural_qc(reads, cfg)
