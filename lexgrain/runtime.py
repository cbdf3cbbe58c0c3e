"""Session helpers: shared checkpoint folder, table loading, materialisation."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and everything runs in one process (``local[...]``, as in
    tests) a temporary folder is made, and remembered in the JVM's checkpoint
    setting; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexgrain-"))
    return str(sc.getCheckpointDir()).rstrip("/")


_SCOPES: list[list[str]] = []


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; it goes with the innermost :func:`intermediates`,
    else when the application ends."""
    path = f"{shared_dir(spark)}/lexgrain-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Scope of written intermediates: those made inside are deleted at its end.

    Results must be written or collected inside, since they are read lazily.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            fs, at = file_system(spark, path)
            fs.delete(at, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    Unlike ``cache()`` the result survives the loss of any executor, and unlike
    ``checkpoint()`` it stays columnar, so later readers prune columns.  For how long
    it stays, see :func:`scratch`.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")
