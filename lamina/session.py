"""The session's needs: this package on the Python workers, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
_workspaces: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds a zip of the package to the application, once; Spark hands it to every executor."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="lamina-ship-")) / f"{top.name}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(target))
        _sent.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a session whose tasks run in the driver's own process may do without: it gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def workspace(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie; deleted by release(), at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/lamina/{spark.sparkContext.applicationId}"
    if path not in _workspaces:
        _workspaces.add(path)
        atexit.register(_at_end, spark.sparkContext, path)
    return path


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: a cut of its lineage that survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of materialise() that nothing reads any more."""
    _delete(df.sparkSession.sparkContext, df.written_to)


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of the application. Results that are not yet computed or stored can't be after it."""
    _delete(spark.sparkContext, workspace(spark))


def _delete(context: SparkContext, path: str) -> None:
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jvm.org.apache.hadoop.conf.Configuration() if context._jsc is None else context._jsc.hadoopConfiguration()).delete(p, True)


def _at_end(context: SparkContext, path: str) -> None:
    try:
        _delete(context, path)
    except Exception as e:  # the JVM may have ended before; what is left is named, not hidden
        print(f"left behind: {path} ({type(e).__name__})", file=sys.stderr)
