"""Reading and writing of documents in the layered text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): one row for each file, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, sha256): files whose bytes aren't valid UTF-8 have a null text."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select(F.col("path").alias("doc_id"), text.alias("text"), F.sha2("content", 256).alias("sha256"))


def stream_text(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: files that arrive in a folder, one row each."""
    return spark.readStream.format("text").option("wholetext", "true").load(path).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def write_text(rendered: DataFrame, path: str, column: str = "text") -> None:
    """Writes a rendered column as text, one row for each document (line ends are kept inside JSON strings)."""
    rendered.select("doc_id", column).write.mode("overwrite").json(path)
