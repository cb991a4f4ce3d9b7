"""Streams of landed files and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landed_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Stream of new PDFs below a folder with their MD5."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    s = s.option("pathGlobFilter", "*.{pdf,PDF}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return s.select("path", F.col("modificationTime").alias("landed"), "length", F.md5("content").alias("file_hash"))


def first_landings(stream: DataFrame, key: str = "file_hash", at: str = "landed", late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark; state is dropped as it passes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, kind: str, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Counts by window and kind; late rows within the watermark are counted."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n")


def session_counts(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by session of a key: rows less than ``gap`` apart belong together."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")
