"""A folder of named tables: created, listed, renamed, truncated and removed through Spark's file systems."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class ExistsError(ValueError):
    """A table is there that should not be, or is not there that should."""


@dataclass(frozen=True)
class Store:
    """Tables as Parquet folders under one folder, in any store that Spark reaches. A write replaces a table whole."""

    spark: SparkSession
    folder: str
    read_only: bool = False

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        top = self._path("")
        return sorted(s.getPath().getName() for s in self._fs().listStatus(top) if s.isDirectory()) if self._fs().exists(top) else []

    def create(self, name: str, df: DataFrame, exclusive: bool = True) -> None:
        """With exclusive, an error if the table is there; without, it is replaced."""
        if self.read_only:
            raise ExistsError("the store is open for reading alone")
        df.write.mode("errorifexists" if exclusive else "overwrite").parquet(f"{self.folder}/{name}")

    def temporary(self, name: str, df: DataFrame) -> DataFrame:
        """A table that ends with the session and is not listed: a view."""
        df.createOrReplaceTempView(name)
        return self.spark.table(name)

    def open(self, name: str) -> DataFrame:
        if name not in self.names():
            raise ExistsError(f"no table {name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def rename(self, old: str, new: str) -> None:
        if self.read_only or old not in self.names() or new in self.names():
            raise ExistsError(f"{old} can't become {new}")
        self._fs().rename(self._path(old), self._path(new))

    def truncate_with(self, name: str, indexes: list[str]) -> int:
        """Leaves a table and the stored tables of its indexes empty; the number of rows that it had."""
        n = self.truncate(name)
        for index in indexes:
            self.truncate(index)
        return n

    def truncate(self, name: str) -> int:
        """Leaves the table empty; the number of rows that it had."""
        df = self.open(name)
        n, schema = df.count(), df.schema
        self.create(name, self.spark.createDataFrame([], schema), exclusive=False)
        return n

    def remove(self, name: str) -> None:
        if self.read_only or name not in self.names():
            raise ExistsError(f"no table {name}")
        self._fs().delete(self._path(name), True)

    def copy(self, name: str, to: Store) -> None:
        """A backup: the same rows in another store."""
        to.create(name, self.open(name))
