"""Sessions, tables and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once a session: they import it for every Python stage. Only its own source files go, from the driver's file server."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # not if it was itself shipped as an archive
        folder = tempfile.mkdtemp(prefix="loamdex-")  # executors that join later fetch it too
        atexit.register(shutil.rmtree, folder, True)
        context.addPyFile(shutil.make_archive(os.path.join(folder, "loamdex"), "zip", _sources(package, folder)))


def _sources(package: str, folder: str) -> str:
    """A folder that holds the package's source files and nothing else."""
    root = os.path.join(folder, "root")
    shutil.copytree(package, os.path.join(root, os.path.basename(package)), ignore=lambda here, names: [n for n in names if not (n.endswith(".py") or os.path.isdir(os.path.join(here, n))) or n == "__pycache__"])
    return root


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a plain local session without that setting gets a temporary folder of its own; on a cluster a missing setting is an error, as a machine-local folder would lose data with its machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loamdex-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Folder below the shared one that holds all that this process writes, so that it can go when the process ends.
_RUN = f"loamdex-{uuid.uuid4().hex}"
_roots: set[str] = set()


def fresh_dir(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing has used. What is written there goes when this process ends."""
    ship(spark)
    root = f"{shared_dir(spark).rstrip('/')}/{_RUN}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(remove, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Best effort: a stopped session leaves the folder to whoever owns the shared one."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session or its gateway is gone
        pass


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage: what follows survives lost executors without the work before it, and plans that use the result several times don't repeat it.
    """
    return materialised(df, fresh_dir(df.sparkSession, tag))


def materialised(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once to ``path`` and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
