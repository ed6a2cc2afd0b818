"""What the operators of this subpackage share: tables, shared folders and Arrow plumbing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and all runs in one
    process (``local[...]``, as in tests) a temporary folder is made once and set for the
    session; on a cluster it would be scattered over the machines, so that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", known)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table to the shared folder and read back.

    Cuts the lineage: a lost executor costs no recomputation of what came before, and what
    reads the table twice computes it once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quire-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def per_batch(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package wherever the driver started."""
    env = df.sparkSession.sparkContext.environment
    paths = env.get("PYTHONPATH", "")
    if _ROOT not in paths.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, paths) if p)

    operator = fn.__module__

    def run(batches):
        turned_to(operator)
        yield from fn(batches)
        given_back()

    return df.mapInArrow(run, schema)


#: How a worker empties the tables it keeps from task to task, and the operator it worked for last.
KEPT: list[Callable[[], None]] = []
_last = ""


def turned_to(operator: str) -> None:
    """Empties the tables of the operator before, so that one's don't come on top of the other's."""
    global _last
    if operator != _last:
        _last = operator
        for forget in KEPT:
            forget()


def given_back() -> None:
    """Returns memory that nothing uses any more to the system: workers live on after a task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def small_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Lets Arrow batches hold so many bytes at most (or one row), in this session. By rows alone
    a batch of long texts has tens of MB, held several times between the JVM and a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` (a string or binary one) holds about ``most_bytes``
    in each, or one row: bounds what a worker has as Python objects at once."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(n, int(n * most_bytes / max(1, batch.column(column).nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def bounded(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows; otherwise as it is,
    for the planner to shuffle. Costs one count, so ``df`` should be a stored table."""
    return F.broadcast(df) if df.count() <= most_rows else df
