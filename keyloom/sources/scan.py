"""Unordered scans of one or several tables."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_all(tables: list[DataFrame], keys: list[str], into: str = "key") -> DataFrame:
    """The keys of several tables as one stream; which table a key is from isn't told."""
    return reduce(DataFrame.unionByName, (t.select(F.col(k).cast("long").alias(into)) for t, k in zip(tables, keys, strict=True)))


def preload(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables (or some columns of each) held by the executors' storage, spilling to disk, and the rows loaded of each."""
    held = {n: (df if columns is None or n not in columns else df.select(*columns[n])).persist(StorageLevel.MEMORY_AND_DISK) for n, df in tables.items()}
    return held, reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in held.items()))


def count_only(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def salvage(versions: DataFrame, key: str, order: str) -> DataFrame:
    """The newest version of each key among rows that may hold several."""
    return versions.groupBy(key).agg(F.max_by(F.struct(*(c for c in versions.columns if c != key)), order).alias("_row")).select(key, "_row.*")
