"""The folder that driver and executors share, tables written there, and this package's code on the executors.

A written table cuts lineage and survives lost executors.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The URI of the session's ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster
    that raises.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="pharmalith-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's files within the shared one; ``close`` deletes it."""
    return f"{shared_dir(spark)}/pharmalith-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the application's folder that nothing uses yet."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def close(spark: SparkSession) -> None:
    """Delete all files that this application wrote to the shared folder. Results that read them can't be computed any more."""
    _delete(spark, run_dir(spark))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries made and run within drop their shuffle files as they end, rather than when the driver's garbage is collected."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = tempfile.mkdtemp(prefix="pharmalith-code-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    name = os.path.join(at, "pharmalith.zip")
    with zipfile.ZipFile(name, "w") as out:
        for d, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(d, f)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)
