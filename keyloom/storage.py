"""Tables that outlive an executor: written to the folder that the cluster shares, and read back."""

from __future__ import annotations

import functools
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="keyloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


def run_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


_written: dict[str, list[str]] = {}


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: short lineage, and no loss with an executor."""
    path = run_dir(df.sparkSession, what)
    df.write.parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Removes the tables that this session has written so; results that read them can't be computed any more. The number removed."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        store, folder = pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)
        store.delete_dir(folder)
    return len(paths)
