"""Intermediate tables that must survive lost executors.

Row numbers and model answers may not change once something depends on them, so they
are written where every executor can read them again, and read back as ordinary
Parquet (which keeps column pruning).

Tables without a folder of the caller's go into one folder per Python process, below the
shared folder; :func:`drop_tables` removes it. :func:`scratch` gives a folder that is
removed at the end of a block.
"""

from __future__ import annotations

import atexit
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_RUN = f"run-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where Spark runs in one process may the setting be absent; then the session's
    warehouse is used, and this process's tables there go when it ends.
    """
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not folder and re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        folder = spark.conf.get("spark.sql.warehouse.dir")
        _remove_at_end(f"{folder.removeprefix('file:').rstrip('/')}/shelfgauge/{_RUN}")
    if not folder:
        raise ValueError(f"Set {_KEY} to a folder all executors share")
    return folder.rstrip("/")


@cache
def _remove_at_end(local_path: str) -> None:
    atexit.register(shutil.rmtree, local_path, ignore_errors=True)


def run_folder(spark: SparkSession) -> str:
    """Where this process puts its intermediate tables."""
    return f"{shared_folder(spark)}/shelfgauge/{_RUN}"


def new_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A fresh path below ``folder``, by default the folder of this process."""
    return f"{(folder or run_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and return a frame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, name, folder)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written to the end."""
    system, target = _file_system(spark, f"{path}/_SUCCESS")
    return system.exists(target)


def store_once(df: DataFrame, path: str) -> DataFrame:
    """Like :func:`store` at a fixed path; what an earlier run wrote there to the end stays."""
    spark = df.sparkSession
    if not is_written(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def move_only_part(spark: SparkSession, folder: str, path: str) -> None:
    """Give the only part file of a written folder a name of its own."""
    system, place = _file_system(spark, folder)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    parts = [found.getPath() for found in system.listStatus(place) if found.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{len(parts)} parts in {folder}")
    if system.exists(target) or not system.rename(parts[0], target):
        raise FileExistsError(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, on whatever file system it lies."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; frames that read them end with them."""
    drop_folder(spark, run_folder(spark))


@contextmanager
def scratch(spark: SparkSession, name: str = "scratch") -> Iterator[str]:
    """A folder for intermediate tables that is removed at the end of the block."""
    path = new_path(spark, name)
    try:
        yield path
    finally:
        drop_folder(spark, path)
