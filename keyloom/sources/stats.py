"""Projections of statistics tables by exact name or by prefix, and deltas between rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import free
from ..operators.ordered import neighbour


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """For each name the column so called, or else all columns that begin with it, in the table's order."""
    chosen = [c for n in names for c in ([n] if n in df.columns else [x for x in df.columns if x.startswith(n)])]
    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(chosen)))


def read_stats(spark: SparkSession, paths: str | list[str], names: list[str]) -> DataFrame:
    """The projection of statistics CSV files, each with its own header; rows that don't fit their header are an error.

    Files of one path have one header. A column that one path's files lack is null there; missing values are null.
    """
    paths = [paths] if isinstance(paths, str) else paths
    read = [spark.read.option("header", True).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(p) for p in paths]
    return project(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read), names)


def deltas(df: DataFrame, by: list[str], time: str, columns: list[str]) -> DataFrame:
    """Each row's columns less those of the row before in its group; the first row keeps its own. Rows are ranged by group and time, so that a large group is cut."""
    before = free("_before", df)
    rows = neighbour(df, [*by, time], before, [*by, *columns], forward=False)
    same = reduce(lambda a, b: a & b, (F.col(f"{before}.{c}").eqNullSafe(F.col(c)) for c in by), F.col(before).isNotNull())
    return rows.withColumns({c: F.col(c) - F.when(same, F.coalesce(F.col(f"{before}.{c}"), F.lit(0))).otherwise(0) for c in columns}).drop(before)
