"""What the training-data operators share: session settings, durable cuts, payload framing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
#: Rows of a few numbers that are worth a file.
ROWS = 50_000


def tune(spark: SparkSession) -> int:
    """Bound the Arrow batches by bytes and rows; return the number of shuffle partitions.

    Texts run from a few bytes to many megabytes, so a batch of 10,000 rows has no
    useful memory bound.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a local folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cellarium-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, executors may be lost.

    ``rows``: about how many narrow rows it has, where its last step is dealt evenly. A few rows then go to a few
    files whatever the number of shuffle partitions: each file of a local file system costs helper processes.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS)))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system, which else stays with this process."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``f`` over batches, with freed memory given back at its end: workers outlive their tasks, and an executor pays for all of them."""

    @wraps(f)
    def run(*args, **kwargs) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(*args, **kwargs)
        finally:
            release()

    return run


def by_key(df: DataFrame, n: int, column: str) -> DataFrame:
    """Send the row with ``column`` = i to partition i of ``n``."""
    return df.repartitionById(n, F.col(column).cast("int"))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and the whole text (null: empty); other columns are left behind, whatever their names."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
