"""Session helpers: the shared folder, cutting lineage, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: str | None = None
_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors see.

    ``spark.checkpoint.dir`` of the session decides. Where it is unset, a local
    master gets a folder of its own, removed at exit; a cluster gets an error,
    since a machine-local folder would lose data with the machine.
    """
    global _own_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="docketflow-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return _own_root


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application, so that Arrow functions can be loaded there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="docketflow-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    _shipped.add(app)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/docketflow/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives lost executors, and is evaluated once
    however often it is used.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only if it holds at most ``max_rows`` rows; otherwise leave the choice to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
