"""Differences between two tables, and checks of order and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Index, Table
from .index import foreign_violations, missing_entries, orphan_entries
from ..storage import written
from .ordered import neighbour, numbered, running


def records(left: Table, right: Table, all_rows: bool = False) -> DataFrame:
    """Keys with `status`: only_left, only_right or different (and on request same)."""
    rest = [c for c in left.df.columns if c not in left.key]
    a = left.df.select(*left.key, F.struct(*rest).alias("_a"))
    b = right.df.select(*right.key, F.struct(*rest).alias("_b"))
    both = a.join(b, list(left.key), "full_outer")
    status = F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("different")
    out = both.select(*left.key, status.alias("status"))
    return out if all_rows else out.where("status != 'same'")


def regions(left: Table, right: Table) -> DataFrame:
    """Runs of differing keys with no equal one between: first and last key and the number of keys, for one-column keys.

    The comparison is written once, as keys and a status; then runs come from one pass in key order: a key that differs
    is in the run whose number is the count of equal keys before it.
    """
    key = left.key[0]
    rows = written(records(left, right, all_rows=True), "compared")
    counted = running(rows, [key], F.when(F.col("status") == "same", 1).otherwise(0), "_equal").where("status != 'same'")
    runs = written(counted.groupBy("_equal").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n")), "runs")
    return numbered(runs, ["first_key"], "region").select("region", "first_key", "last_key", "n")


def blocks(left: Table, right: Table, size: int = 1024) -> DataFrame:
    """Blocks of `size` key values by their counts and checksums on both sides: block, n_left, n_right, equal; for one integer key.

    Each side is summed where it lies, so that of a table only a row per block and task travels.
    """
    key = left.key[0]

    def side(t: Table, name: str) -> DataFrame:
        row = F.xxhash64(*(F.col(c) for c in left.df.columns)).cast("decimal(38,0)")
        return t.df.groupBy(F.floor(F.col(key) / size).alias("block")).agg(F.count("*").alias(f"n_{name}"), F.sum(row).alias(f"sum_{name}"), F.bit_xor(F.xxhash64(*(F.col(c) for c in left.df.columns))).alias(f"xor_{name}"))

    both = side(left, "left").join(side(right, "right"), "block", "full_outer")
    equal = F.col("sum_left").eqNullSafe(F.col("sum_right")) & F.col("xor_left").eqNullSafe(F.col("xor_right")) & F.col("n_left").eqNullSafe(F.col("n_right"))
    return both.select("block", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"), equal.alias("equal"))


def block_records(left: Table, right: Table, size: int = 1024, most: int | None = None) -> DataFrame:
    """As records(), but only rows of blocks that differ are compared; with most, the first so many differences by key."""
    key = left.key[0]
    odd = blocks(left, right, size).where("not equal").select(F.col("block").alias("_block"))
    a, b = (t.of(t.df.join(odd, F.floor(F.col(key) / size) == F.col("_block"), "left_semi")) for t in (left, right))
    out = records(a, b)
    return out if most is None else out.orderBy(key).limit(most)


def misplaced(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; in a table with unique keys there are none."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def stored(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of a Parquet scan with _file and _row, the place of each row in what is stored."""
    return df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def disorder(df: DataFrame, key: str, place: tuple[str, ...] = ("_file", "_row")) -> DataFrame:
    """One row with `out_of_order`: the rows whose key is before that of the row before them, in the order of `place`.

    place: columns that tell where a row is stored, as those of stored(). Repeated keys are misplaced()'s matter.
    """
    rows = neighbour(df.select(key, *place), list(place), "_before", [key], forward=False)
    return rows.where(F.col(f"_before.{key}") > F.col(key)).agg(F.count("*").alias("out_of_order"))


def verify(table: Table, index: Index, entries: DataFrame, related: Table | None = None) -> DataFrame:
    """One row per check of a stored index with the number of failures."""
    checks = {"missing": missing_entries(table, index, entries), "orphan": orphan_entries(table, index, entries)}
    if related is not None:
        checks["foreign"] = foreign_violations(table, index, related)
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = one if out is None else out.unionByName(one)
    return out

