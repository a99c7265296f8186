"""Session factory and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
#: The temporary folder of a local session without spark.checkpoint.dir, by application.
_own: dict[str, str] = {}


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; an own one only where that is unset, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        # a core setting can't be set while the session runs
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds: long texts would otherwise fill workers and direct buffers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def lean(run):
    """A function over batches that hands its worker's freed memory back to the system when it ends: workers live on between tasks."""

    def wrapped(batches):
        import ctypes
        import sys

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed when the driver ends."""
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    # these tables hold whole texts at times: a denser codec keeps the shared folder small
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


def sized(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Hint a broadcast if a written table of a few numbers a row is no longer than so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def drop_scratch(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing will read it again."""
    path = getattr(df, "_corpusloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written if spark else []:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone at exit
            return
