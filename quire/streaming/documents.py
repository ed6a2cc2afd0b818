"""Documents as a stream: files that arrive are parsed, checked or cut as they come.

Parsing, conversion of single elements and row-local rules keep no state, so they run on a
stream unchanged, without watermarks. What gathers a document's elements works on each batch,
since a document is one file and arrives whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.parse import elements, parse
from quire.sources.files import stream_text


def stream_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of all documents that arrive at a folder."""
    return elements(parse(stream_text(spark, path)))


def each_batch(spark: SparkSession, path: str, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Applies an operator on elements (chunking, merging, validation) to every batch of new
    documents and appends its rows as Parquet; exactly once per batch, by the checkpoint."""

    def run(batch: DataFrame, batch_id: int) -> None:
        operator(elements(parse(batch))).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream_text(spark, path).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
