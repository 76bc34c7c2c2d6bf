"""Joins over declared keys, and counts of duplicates and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Index, Table, free
from .index import view


def related_rows(parents: Table, condition: Column, children: Table, index: Index) -> DataFrame:
    """Rows of children whose secondary key is the key of a parent that meets the condition (one to many)."""
    parent = free("_parent", children.df)
    keys = parents.df.where(condition).select(F.col(parents.key[0]).alias(parent))
    if not index.many:
        rows = children.df if index.only is None else children.df.where(index.only)
        return rows.join(keys, index.column == F.col(parent), "left_semi")
    entries = view(children, index).join(keys, F.col(index.name) == F.col(parent), "left_semi")
    return children.df.join(entries.select(*children.key), list(children.key), "left_semi")


def through(left: Table, links: DataFrame, right: Table, left_key: str, right_key: str) -> DataFrame:
    """Many-to-many: rows of both tables side by side for each row of the linking table."""
    return links.join(left.df, F.col(left_key) == left.df[left.key[0]]).join(right.df, F.col(right_key) == right.df[right.key[0]])


def duplicate_count(table: Table, key: tuple) -> DataFrame:
    """The number of rows of one key."""
    return table.df.where(table.key_is(*key)).agg(F.count("*").alias("n"))


def duplicate_counts(table: Table) -> DataFrame:
    return table.df.groupBy(*table.key).agg(F.count("*").alias("n"))


def estimated_keys(table: Table, error: float = 0.05) -> DataFrame:
    """About how many distinct keys there are, by a sketch."""
    return table.df.agg(F.approx_count_distinct(F.struct(*table.key), error).alias("n"))


def estimated_duplicates(table: Table, key: tuple, by: str, one_in: int = 8) -> DataFrame:
    """About how many rows a key has: those of a sample of one in so many, by a hash of a column of the duplicates, times that.

    The key's rows alone are read as far as the scan can prune; a key with rows has one at least.
    """
    place = F.conv(F.substring(F.md5(F.col(by).cast("string")), 1, 8), 16, 10).cast("long")
    hits = F.count(F.when(F.pmod(place, F.lit(one_in)) == 0, 1))
    return table.df.where(table.key_is(*key)).agg(F.greatest(F.least(F.count("*"), F.lit(1)), hits * one_in).alias("n"))


def space(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """For each table its rows, files and bytes, from what the scans tell of their files."""
    one = []
    for name, path in paths.items():
        files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f").agg(F.count("*").alias("n"), F.max("b").alias("b"))
        one.append(files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")).withColumn("name", F.lit(name)))
    return reduce(DataFrame.unionByName, one)


def distinct_keys(table: Table) -> DataFrame:
    return table.df.select(*table.key).distinct()


def key_bounds(table: Table) -> DataFrame:
    """The first and the last key; one row, null if the table is empty."""
    return table.df.agg(F.min(F.struct(*table.key)).alias("first_key"), F.max(F.struct(*table.key)).alias("last_key"))
