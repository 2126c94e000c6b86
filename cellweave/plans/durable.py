"""Intermediate tables that outlive lost executors and cut the lineage of iterative operators."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only where there are none, in local mode, a temporary one stands in for a missing setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cellweave-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_folder: ContextVar[str | None] = ContextVar("folder", default=None)
_count: ContextVar[Iterator[int] | None] = ContextVar("count", default=None)

#: Tables between two times that the driver gives memory back, in ``scratch``.
RELIEF = 4


def folder(spark: SparkSession) -> str:
    """Where tables are written now."""
    return _folder.get() or shared_dir(spark)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go as soon as each has ended, since what is read again is the written table."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder, read with its own schema (no inference)."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with passing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    if (count := _count.get()) and next(count) % RELIEF == 0:
        relieve(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(df: DataFrame) -> DataFrame:
    """df for a join that broadcasts neither side: Spark sizes exploded rows by what they are made of, and tables by files that pack ids well, both far too low."""
    return df.hint("merge")


def relieve(spark: SparkSession) -> bool:
    """The driver lets go of ended queries: their broadcasts stay until it happens to collect its garbage, and its C library keeps what their threads and compilers have freed.

    False if the virtual machine has no command for the latter.
    """
    jvm = spark._jvm
    jvm.System.gc()
    try:
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")  # the server's own class is not public
        call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:
        return False
    return True


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted at the end, but for those written by the function that it gives; the driver gives memory back as they are written."""
    outer, path = _folder.get(), f"{folder(spark)}/scratch-{uuid.uuid4().hex}"
    token, counting = _folder.set(path), _count.set(itertools.count())

    def lasting(df: DataFrame, name: str) -> DataFrame:
        inner = _folder.set(outer)
        try:
            return durable(df, name)
        finally:
            _folder.reset(inner)

    try:
        yield lasting
    finally:
        _folder.reset(token)
        _count.reset(counting)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)  # any file system that Spark can write to
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
