"""Log files and exported packet captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.json import is_json
from sieveline.sources.json_blocks import read_json_values
from sieveline.sources.normalize import non_blank_lines


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of log files, with the file they came from."""
    return non_blank_lines(spark.read.text(path).withColumn("file", F.col("_metadata.file_path")))


def stream_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Follow a folder of log files; rotation is by new file."""
    return non_blank_lines(
        spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    )


def read_capture(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Exported captures as one JSON text per row.

    ``json``: files hold JSON documents one after another, each over as many lines
    as it likes; an array yields one row per element. Files are read in parallel by
    blocks, however large a document is (see ``json_blocks``). Text that isn't
    JSON is left out. Any other format: one document per line.
    """
    if fmt == "json":
        return read_json_values(spark, path).select("value").where(is_json(F.col("value")))
    return non_blank_lines(spark.read.text(path)).where(is_json(F.col("value")))
