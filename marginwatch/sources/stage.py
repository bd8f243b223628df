"""Writing an intermediate result once for several readers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_named: dict[str, str] = {}


def use_stage_dir(folder: str) -> None:
    """Name the shared folder for sessions that do not set ``spark.checkpoint.dir``."""
    _named["dir"] = folder


def use_temporary_stage_dir() -> None:
    """For tests and single-machine runs: a folder that goes when the process ends."""
    if "dir" not in _named:
        use_stage_dir(tempfile.mkdtemp(prefix="marginwatch-"))
        atexit.register(shutil.rmtree, _named["dir"], ignore_errors=True)


def setting(spark: SparkSession) -> str | None:
    return spark.conf.get(SETTING, None)


def stage_dir(spark: SparkSession) -> str:
    """The shared folder, the same for every master; an error if none is named."""
    folder = setting(spark) or _named.get("dir")
    if not folder:
        raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
    return folder


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Removes what was staged inside it, also after a failure. Results must be written by then.

    Folders are removed through Hadoop's file system, so any shared store will do.
    """
    outer = _named.get("scope")
    folder = f"{stage_dir(spark)}/marginwatch-{spark.conf.get('spark.app.id')}/scope-{uuid.uuid4().hex}"
    _named["scope"] = folder
    try:
        yield
    finally:
        _named.pop("scope")
        if outer:
            _named["scope"] = outer
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as parquet to the shared folder and read back. This runs jobs at once.

    Readers then share one computation and survive lost executors without repeating it.
    Readers of a plan are not always served by one shuffle: column pruning may leave them
    with different ones. The files' size also tells the planner what it may broadcast. With
    ``by`` the rows are kept apart by that column, and a filter on it reads its files only.
    Each run writes to a folder of its own, under the application's id; in a
    :func:`staging_scope` the folder goes with the scope.
    """
    spark = df.sparkSession
    folder = _named.get("scope") or f"{stage_dir(spark)}/marginwatch-{spark.conf.get('spark.app.id')}"
    path = f"{folder}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
