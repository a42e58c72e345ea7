"""Session settings and the shared scratch folder."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("echofind")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Not needed where the package is installed on the cluster or was passed
    with ``--py-files``. The driver packs the archive; Spark hands it out.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="echofind-"), "echofind")
    root, name = os.path.split(package)
    spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", root, name))
    _shipped.add(application)


def _one_machine(spark: SparkSession) -> bool:
    """Whether driver and tasks share one process (not so under ``local-cluster``)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


_fallback: dict[str, str] = {}
_scope = threading.local()


def _base(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, under ``spark.checkpoint.dir``.

    The cluster names a folder all executors share. Only a local session may
    fall back to a temporary folder of this machine, one per application.
    """
    base, application = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not _one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = _fallback.setdefault(application, "") or tempfile.mkdtemp(prefix="echofind-")
        _fallback[application] = base
    return f"{base.rstrip('/')}/echofind/{application}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table."""
    path = f"{_base(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables this application wrote.

    Call it once no result is in use: results may read from these tables.
    """
    _delete(spark, _base(spark))


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Delete the intermediate tables written inside, in this thread, when it ends.

    For work whose result has been written by then, such as a micro-batch.
    """
    outer = getattr(_scope, "paths", None)
    _scope.paths = []
    try:
        yield
    finally:
        for path in _scope.paths:
            _delete(spark, path)
        _scope.paths = outer


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Used where a plan would otherwise run several times, or where its row ids
    must not change when a lost task is run again.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint for a written table, if it has few enough rows.

    Beyond that the join is left to Spark, which shuffles both sides.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """In a local session, use all cores on an input of few splits, such as one row group.

    On a cluster nothing is done: splits are for ``spark.sql.files.*`` to set.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if not _one_machine(df.sparkSession) or df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys)
