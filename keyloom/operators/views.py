"""Map, set and list views of a table, and set algebra between them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Table
from .cursor import KeyRange, up
from .dml import delete, put, update_rows
from .ordered import numbered


@dataclass(frozen=True)
class MapView:
    """A table as a map from its key to its rows, within bounds of its first key column."""

    table: Table
    bounds: KeyRange = KeyRange()

    @property
    def rows(self) -> DataFrame:
        return self.table.df.where(self.bounds.condition(self.table.key[0]))

    def sub_map(self, begin=None, end=None, begin_inclusive: bool = True, end_inclusive: bool = False) -> MapView:
        return replace(self, bounds=self.bounds.sub_range(begin, begin_inclusive, end, end_inclusive))

    def head_map(self, end, inclusive: bool = False) -> MapView:
        return self.sub_map(end=end, end_inclusive=inclusive)

    def tail_map(self, begin, inclusive: bool = True) -> MapView:
        return self.sub_map(begin=begin, begin_inclusive=inclusive)

    def key_set(self) -> DataFrame:
        return self.rows.select(*self.table.key).distinct()

    def entry_set(self) -> DataFrame:
        return self.rows

    def values(self) -> DataFrame:
        return self.rows.select(*(c for c in self.table.df.columns if c not in self.table.key))

    def duplicates(self, *key) -> DataFrame:
        return self.rows.where(self.table.key_is(*key)).drop(*self.table.key)

    def size(self) -> DataFrame:
        """Counts duplicates; the size of key_set() does not."""
        return self.rows.agg(F.count("*").alias("n"))

    def contains_key(self, *key) -> bool:
        return not self.rows.where(self.table.key_is(*key)).isEmpty()

    def contains_value(self, condition: Column) -> bool:
        return not self.rows.where(condition).isEmpty()

    def get(self, *key) -> DataFrame:
        """The values of a key: none or one row, with duplicates the least."""
        return self.rows.where(self.table.key_is(*key)).orderBy(*up(self.table.order)).limit(1).drop(*self.table.key)

    def remove(self, *key) -> MapView:
        """Without a key; one that isn't there, or out of the bounds, changes nothing."""
        return replace(self, table=self.table.of(self.table.df.where(~(self.table.key_is(*key) & self.bounds.condition(self.table.key[0])))))

    def remove_value(self, key: tuple, condition: Column) -> MapView:
        """Without the rows of a key whose value meets the condition."""
        return replace(self, table=self.table.of(self.table.df.where(~(self.table.key_is(*key) & F.coalesce(condition, F.lit(False))))))

    def replace_value(self, key: tuple, condition: Column, **values) -> MapView:
        """The row of a key with other values, if its present ones meet the condition."""
        return replace(self, table=update_rows(self.table, self.table.key_is(*key) & condition, **{c: F.lit(v) for c, v in values.items()}))

    def value_set(self) -> DataFrame:
        """The distinct values; order them by their columns for a sorted set."""
        return self.values().distinct()

    def put_all(self, new: DataFrame) -> MapView:
        """The map with new rows; a key outside of the bounds raises an error when it is written."""
        inside = F.when(self.bounds.condition(self.table.key[0]), F.col(self.table.key[0])).otherwise(F.raise_error(F.lit("a key is out of range")))
        return replace(self, table=put(self.table, new.withColumn(self.table.key[0], inside.cast(new.schema[self.table.key[0]].dataType))))

    def clear(self) -> MapView:
        return replace(self, table=delete(self.table, self.rows))


def _same(left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column]:
    """right under names of its own, and the condition that a row of it equals one of left; null equals null."""
    names = [f"_r{i}" for i in range(len(right.columns))]
    pairs = [F.col(n).eqNullSafe(left[c]) for n, c in zip(names, right.columns)]
    return right.toDF(*names), reduce(lambda a, b: a & b, pairs)


def contains_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row with `contained`: whether every row of right is in left."""
    missing = right.select(*left.columns).subtract(left)
    return missing.limit(1).agg((F.count("*") == 0).alias("contained"))


def add_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def remove_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of left, repeated ones too, that right has not."""
    other, same = _same(left, right)
    return left.join(other, same, "left_anti")


def retain_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of left, repeated ones too, that right has."""
    other, same = _same(left, right)
    return left.join(other, same, "left_semi")


def equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row with `equal`: whether both hold the same rows, each as often."""
    marked = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    odd = marked.groupBy(*left.columns).agg(F.sum("_side").alias("_n")).where("_n != 0").limit(1)
    return odd.agg((F.count("*") == 0).alias("equal"))


@dataclass(frozen=True)
class ListView:
    """Rows by position, from 0, in key order."""

    table: Table

    @property
    def positions(self) -> DataFrame:
        return numbered(self.table.df, list(self.table.order), "index").withColumn("index", F.col("index") - 1)

    def get(self, index: int) -> DataFrame:
        return self.sub_list(index, index + 1)

    def sub_list(self, begin: int, end: int) -> DataFrame:
        return self.positions.where((F.col("index") >= begin) & (F.col("index") < end))

    def index_of(self, condition: Column) -> DataFrame:
        return self.positions.where(condition).agg(F.min("index").alias("index"))

    def last_index_of(self, condition: Column) -> DataFrame:
        return self.positions.where(condition).agg(F.max("index").alias("index"))

    def set(self, index: int, **values) -> DataFrame:
        """The list with other values at a position; as all writes, with the positions as column `index`."""
        here = F.col("index") == index
        return self.positions.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})

    def insert(self, index: int, new: ListView) -> DataFrame:
        """The list with another list's rows before a position; those from there on move up."""
        rows, own = new.positions.withColumn("index", F.col("index") + index), self.positions
        n = new.table.df.agg(F.count("*").alias("_n"))
        moved = own.join(F.broadcast(n), F.lit(True)).withColumn("index", F.col("index") + F.when(F.col("index") >= index, F.col("_n")).otherwise(0)).drop("_n")
        return moved.unionByName(rows)

    def remove(self, index: int, count: int = 1) -> DataFrame:
        """The list without count rows from a position on; those after them move down."""
        rows = self.positions.where((F.col("index") < index) | (F.col("index") >= index + count))
        return rows.withColumn("index", F.when(F.col("index") >= index, F.col("index") - count).otherwise(F.col("index")))
