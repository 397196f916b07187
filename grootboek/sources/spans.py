"""Lines of text files in spans of bounded length, so that no task has to order a whole file block.

A span is a stretch of consecutive lines of one block. What a line needs of the lines before or after its span is one
row per span, a small table beside the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: A span has up to two to the power of so many lines.
SPAN_BITS = 12
KEYS = ["file", "block", "span"]


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Lines with their ``file``, the ``block`` they came from and their order in it, and the ``size`` of the file."""
    text = spark.read.option("lineSep", "\n").option("encoding", encoding).text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def in_spans(lines: DataFrame) -> DataFrame:
    """``lines`` with the number of their span, which rises with ``seq`` inside a block."""
    return lines.withColumn("span", F.shiftright("seq", SPAN_BITS))


def in_file() -> WindowSpec:
    """The spans of one file in their order."""
    return Window.partitionBy("file").orderBy("block", "span")


def in_span() -> WindowSpec:
    """The lines of one span in their order."""
    return Window.partitionBy(*KEYS).orderBy("seq")
