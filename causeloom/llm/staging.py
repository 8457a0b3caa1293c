"""Intermediate tables in the folder that all executors share.

A staged table is an ordinary Parquet table below ``spark.checkpoint.dir``.  It
cuts lineage, survives the loss of any executor, carries exact size statistics
(so that Spark decides by the measured size whether a join side is broadcast)
and freezes anything that must not be computed twice, such as row numbers.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a table is staged: long texts make batches of Spark's usual size too large.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_SETTING = "spark.checkpoint.dir"
_fallback: dict[str, str] = {}
_scopes: list[list[tuple[str, str]]] = []
_registered: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application below ``spark.checkpoint.dir``.

    Only in a local session without the setting, as in a test, a temporary folder of this
    machine is used; on a cluster the setting must be there.
    """
    context = spark.sparkContext
    base = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
    app = context.applicationId
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        if app not in _fallback:
            _fallback[app] = tempfile.mkdtemp(prefix="causeloom-")
        base = _fallback[app]
    folder = f"{base.rstrip('/')}/causeloom-{app}"
    if app not in _registered:
        _registered.add(app)
        atexit.register(_clean_quietly, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clean_quietly(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            _delete(spark, folder)
        except Exception:  # the JVM may have ended before this interpreter
            pass


def clean(spark: SparkSession) -> None:
    """Delete every staged table of this application; results that still read one become invalid."""
    _delete(spark, shared_dir(spark))


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_ROWS`` rows for what is executed inside."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def give_back() -> None:
    """Return memory that a worker has freed to the system, for what runs on the executor next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free(spark: SparkSession) -> None:
    """Free the files of shuffles that nothing refers to any more; events of ended jobs that wait for listeners still do."""
    gc.collect()
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Py4JError:  # they take longer, and are freed another time
        pass
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Delete the tables staged inside, but for those named ``keep``, which what is returned still reads.

    Shuffles whose tables are gone are freed as well, as far as nothing refers to them.
    """
    _scopes.append([])
    try:
        yield
    finally:
        made = _scopes.pop()
        for name, path in made:
            if name not in keep:
                _delete(spark, path)
            elif _scopes:
                _scopes[-1].append((name, path))
        free(spark)


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = staged_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    if _scopes:
        _scopes[-1].append((name, path))
    return spark.read.schema(df.schema).parquet(path)
