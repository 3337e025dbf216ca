"""What operators need of a cluster: this package in the Python workers, and the folder that all machines share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()
_scratch: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once per application, through Spark's own file server.

    Executors may start in any folder, so they can't be expected to find the
    sources by themselves.
    """
    if (app := spark.sparkContext.applicationId) in _sent:
        return
    root = Path(__file__).resolve().parent
    path = Path(os.path.realpath(tempfile.mkdtemp())) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(path))
    _sent.add(app)


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only on one machine (a local master) a temporary one stands in for it, and goes with the process."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="zonewise-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path that driver and executors share. Within ``scratch`` it is deleted at the end."""
    path = f"{_checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the shared folders that are named inside; what was read from them must have been written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_folder`` named, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: For checkpoints in local folders: else Hadoop starts two ``chmod`` processes for each file, and each is a copy of the JVM for a moment.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@contextmanager
def _plain_files(spark: SparkSession) -> Iterator[None]:
    """Inside, checkpoints in local folders are written without checksum files; other stores, and plans made before, are untouched."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = {k: conf.get(k) for k in PLAIN_FILES}
    for k, v in PLAIN_FILES.items():
        conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there."""
    _checkpoint_folder(df.sparkSession)
    out = df.checkpoint(eager=False)  # plans df and runs all but its last stage, by the session's own settings
    with _plain_files(df.sparkSession):
        out._jdf.queryExecution().logical().rdd().doCheckpoint()
    return out
