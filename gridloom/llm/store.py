"""Tables, intermediate storage and Arrow mapping shared by the llm operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 512
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df once under the shared folder and read it back.

    Cuts lineage and fixes row contents for every later reader; the files are on
    shared storage, so losing an executor loses nothing. They go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        for spark, path in [x for x in _written if any(x[1] in f for f in df.inputFiles()[:1])]:
            _delete(spark, path)
            _written.remove((spark, path))


def swept(since: int, *kept: DataFrame) -> None:
    """Delete the tables stored since a `mark` that none of `kept` reads."""
    files = [f for df in kept for f in df.inputFiles()]
    for spark, path in _written[since:]:
        if not any(path.rpartition("/")[2] in f for f in files):
            _delete(spark, path)
            _written.remove((spark, path))


def collected(spark: SparkSession) -> None:
    """Let the driver find what no one holds any more: only then does Spark delete its shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mark() -> int:
    """A point in the order of stored tables."""
    return len(_written)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone
            return


def returning(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn, and at its end what it freed goes back to the system: workers live on from stage to stage."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of ROWS_PER_BATCH rows at most; maxBytesPerBatch bounds the bytes of
    longer texts. Plans read the setting when they run, which may be long after this call, so
    a session that leaves Spark's default gets it for good; a smaller one is kept."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_ROWS)) > ROWS_PER_BATCH:
        conf.set(BATCH_ROWS, str(ROWS_PER_BATCH))
    return df.mapInArrow(returning(fn), schema)


def fold(key: str, modulus: int):
    """crc32 of the id's decimal text, modulo; a null id gives remainder 0's complement: null -> -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(-1))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns (extra columns, also clashing ones, stay out)."""
    return df.select(*names)
