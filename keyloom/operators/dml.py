"""Writes as functions from tables to tables, sequences, and what deleting a row does to those that refer to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Index, Table, free
from .index import view
from .ordered import numbered


class ConstraintError(ValueError):
    """A write would break a declared constraint."""


def _once(table: Table, new: DataFrame, order: tuple[str, ...], first: bool) -> DataFrame:
    """new with each key once: the last row (or the first) by `order`; without order, rows of one key that differ raise an error."""
    columns = table.df.columns
    rest = [c for c in columns if c not in table.key]
    if not rest:
        return new.select(*columns).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in rest))
    if order:
        best = (F.min_by if first else F.max_by)(row, F.struct(*order))
        return new.groupBy(*table.key).agg(best.alias("_row")).select(*(c if c in table.key else F.col(f"_row.`{c}`").alias(c) for c in columns))
    both = new.groupBy(*table.key).agg(F.min(row).alias("_row"), F.max(row).alias("_other"))
    checked = F.when(F.col("_row").eqNullSafe(F.col("_other")), F.col("_row")).otherwise(F.raise_error(F.lit("a key is put twice with different data")).cast(both.schema["_row"].dataType))
    return both.select(*table.key, checked.alias("_row")).select(*(c if c in table.key else F.col(f"_row.`{c}`").alias(c) for c in columns))


def put(table: Table, new: DataFrame, mode: str = "OVERWRITE", order: tuple[str, ...] = ()) -> Table:
    """OVERWRITE, NO_OVERWRITE or NO_DUP_DATA of rows.

    OVERWRITE replaces the row of a key, or adds a duplicate that is not there. NO_OVERWRITE adds rows of keys that
    are not there. NO_DUP_DATA adds duplicates that are not there. Of rows of new with one key the last by the columns
    `order` of new counts (with NO_OVERWRITE the first); without order such rows must be equal, or an error is raised
    when they are read. In a table with duplicates, new's equal (key, data) pairs count once.
    """
    if mode == "NO_DUP_DATA" and not table.duplicates:
        raise ValueError("NO_DUP_DATA needs a table with duplicates")
    if table.duplicates:
        new = new.select(*table.df.columns).dropDuplicates(list(table.order))
    else:
        new = _once(table, new, order, mode == "NO_OVERWRITE")
    if mode == "NO_OVERWRITE":
        return table.of(table.df.unionByName(new.join(table.df.select(*table.key), list(table.key), "left_anti")))
    if table.duplicates:
        return table.of(table.df.unionByName(new.join(table.df.select(*table.order), list(table.order), "left_anti").select(*table.df.columns)))
    return table.of(table.df.join(new.select(*table.key), list(table.key), "left_anti").select(*table.df.columns).unionByName(new))


def put_status(table: Table, new: DataFrame, mode: str = "OVERWRITE") -> DataFrame:
    """For each key (with NO_DUP_DATA: pair) of new, `status`: KEYEXIST where the mode refuses it, else SUCCESS; `is_update`: whether a row is replaced."""
    on = list(table.order if mode == "NO_DUP_DATA" else table.key)
    there = table.df.select(*on).distinct().withColumn("_there", F.lit(True))
    rows = new.select(*on).distinct().join(there, on, "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    refused = F.col("_there") & F.lit(mode in ("NO_OVERWRITE", "NO_DUP_DATA"))
    return rows.select(*on, F.when(refused, "KEYEXIST").otherwise("SUCCESS").alias("status"), (F.col("_there") & F.lit(mode == "OVERWRITE" and not table.duplicates)).alias("is_update"))


def delete_status(table: Table, keys: DataFrame) -> DataFrame:
    """For each key `status`: SUCCESS if there is a row to delete, else NOTFOUND; `n`: the rows deleted."""
    counts = table.df.join(keys.select(*table.key), list(table.key), "left_semi").groupBy(*table.key).agg(F.count("*").alias("n"))
    rows = keys.select(*table.key).distinct().join(counts, list(table.key), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("n") > 0, "SUCCESS").otherwise("NOTFOUND"))


def put_assigned(table: Table, new: DataFrame, first: int = 1) -> Table:
    """put() of rows whose key is null or 0 under new keys: after the greatest of the table and of new, by the order of their columns."""
    key = table.key[0]
    missing = F.col(key).isNull() | (F.col(key) == 0)
    given, rows = new.where(~missing), new.where(missing).drop(key)
    both = table.df.select(key).unionByName(given.select(key))
    top = both.agg(F.greatest(F.coalesce(F.max(key), F.lit(0)), F.lit(first - 1)).alias("_top"))
    rows = numbered(rows, rows.columns, "_n").join(F.broadcast(top), F.lit(True))
    rows = rows.withColumn(key, (F.col("_top") + F.col("_n")).cast(table.df.schema[key].dataType))
    return put(table, given.select(*table.df.columns).unionByName(rows.select(*table.df.columns)))


def update_rows(table: Table, condition: Column, **values: Column) -> Table:
    """The rows that meet a condition with other data, as expressions of their columns; keys and the data that order duplicates stay."""
    if set(values) & set(table.order):
        raise ConstraintError("the position of a row can't change")
    hit = F.coalesce(condition, F.lit(False))
    return table.of(table.df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}))


def put_returning(table: Table, new: DataFrame) -> DataFrame:
    """For each row of new: its key, and the row it replaces as struct `previous` (null if none)."""
    old = table.df.select(*table.key, F.struct(*(c for c in table.df.columns if c not in table.key)).alias("previous"))
    return new.select(*table.key).join(old, list(table.key), "left")


def put_current(table: Table, key: tuple, **values) -> Table:
    """The row of a key with other data; key columns (and data that order duplicates) may not change."""
    if set(values) & set(table.order):
        raise ConstraintError("the position of a row can't change")
    here = table.key_is(*key)
    return table.of(table.df.withColumns({c: F.when(here, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}))


def replace(table: Table, new: DataFrame, old: DataFrame | None = None) -> Table:
    """Rows of keys that are there (and, given old, still equal it) replaced by new."""
    there = table.df if old is None else table.df.intersect(old.select(*table.df.columns))
    hits = new.join(there.select(*table.key), list(table.key), "left_semi")
    return put(table, hits)


def delete(table: Table, keys: DataFrame, both: bool = False) -> Table:
    """Without the rows of these keys; with both, of these (key, data) pairs."""
    on = list(table.order if both else table.key)
    return table.of(table.df.join(keys.select(*on), on, "left_anti").select(*table.df.columns))


def delete_by_index(table: Table, index: Index, values: DataFrame) -> Table:
    """Without the rows that these secondary keys lead to. A row of a single-valued index tells its key, so one join does."""
    gone = free("_gone", table.df)
    values = values.select(F.col(values.columns[0]).alias(gone))
    if not index.many:
        held = index.column if index.only is None else F.when(index.only, index.column)
        return table.of(table.df.join(values, held == F.col(gone), "left_anti"))
    keys = view(table, index).join(values, F.col(index.name) == F.col(gone), "left_semi")
    return delete(table, keys.select(*table.key).distinct())


def partial_read(column: str | Column, offset: int, length: int) -> Column:
    """The bytes at offset .. offset + length of a binary column, or of a string's UTF-8."""
    c = F.col(column) if isinstance(column, str) else column
    return F.substring(c.cast("binary"), offset + 1, length)


def partial_update(column: str | Column, offset: int, length: int, value: bytes | str) -> Column:
    """The bytes of a column with those at offset .. offset + length replaced by value, of any length; a gap is filled with NUL."""
    c = (F.col(column) if isinstance(column, str) else column).cast("binary")
    new = F.lit(value.encode() if isinstance(value, str) else value)
    head = F.rpad(F.substring(c, 1, offset), offset, F.lit(b"\0")) if offset else F.lit(b"")
    return F.concat(head, new, F.substring(c, F.lit(offset + length + 1), F.greatest(F.octet_length(c), F.lit(1))))


def sequence(table: Table, into: str, first: int = 1, step: int = 1, low: int = -(1 << 63), high: int = (1 << 63) - 1, wrap: bool = False) -> DataFrame:
    """Numbers for the rows in key order: first, first + step, ... within low .. high.

    A step below 0 counts down. With wrap, a value that would pass a limit starts again at the other end; fewer than
    |step| values before a limit are skipped. Without it, rows past the limit raise an error when they are computed.
    """
    if not low <= first <= high or not step:
        raise ValueError("the first value must be within the limits, and the step not 0")
    rows = numbered(table.df, list(table.order), "_n").withColumn("_n", F.col("_n") - 1)
    room = (high - first) // step if step > 0 else (first - low) // -step
    n = F.col("_n")
    value = F.lit(first) + n * step
    if wrap:
        start, lap = (low, (high - low) // step + 1) if step > 0 else (high, (high - low) // -step + 1)
        value = F.when(n <= room, value).otherwise(F.lit(start) + F.pmod(n - (room + 1), F.lit(lap)) * step)
    else:
        value = F.when(n <= room, value).otherwise(F.raise_error(F.lit("the sequence has no more values")).cast("long"))
    return rows.withColumn(into, value).drop("_n")


def append(table: Table, new: DataFrame) -> Table:
    """Rows without key added after the greatest key, numbered in the order of their columns."""
    key = table.key[0]
    top = table.df.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    rows = numbered(new, new.columns, "_n").join(F.broadcast(top), F.lit(True))
    return table.of(table.df.unionByName(rows.withColumn(key, (F.col("_top") + F.col("_n")).cast(table.df.schema[key].dataType)).select(*table.df.columns)))


def referrers(table: Table, index: Index, deleted: DataFrame) -> DataFrame:
    """The index entries that refer to deleted keys (one column)."""
    gone = deleted.select(F.col(deleted.columns[0]).alias("_gone"))
    return view(table, index).join(gone, F.col(index.name) == F.col("_gone"), "left_semi")


def on_delete(table: Table, index: Index, deleted: DataFrame) -> Table:
    """What is left of a table when keys of the table it refers to are deleted, by the index's rule.

    ABORT raises ConstraintError if a row refers to one. CASCADE drops such rows. NULLIFY clears the field, or takes
    the keys out of the array.
    """
    hits = referrers(table, index, deleted)
    if index.on_delete == "ABORT":
        if not hits.isEmpty():
            raise ConstraintError(f"rows refer to deleted keys by {index.name}")
        return table
    if index.on_delete == "CASCADE":
        return delete_by_index(table, index, deleted)
    names = table.df.columns
    if index.many:
        gone = hits.groupBy(*table.key).agg(F.collect_set(index.name).alias("_gone"))
        rows = table.df.join(gone, list(table.key), "left")
        return table.of(rows.withColumn(index.key, F.when(F.col("_gone").isNull(), F.col(index.key)).otherwise(F.array_except(index.key, "_gone"))).select(*names))
    gone, hit = free("_gone", table.df), free("_hit", table.df)
    held = index.column if index.only is None else F.when(index.only, index.column)
    lost = deleted.select(F.col(deleted.columns[0]).alias(gone)).distinct().withColumn(hit, F.lit(True))
    rows = table.df.join(lost, held == F.col(gone), "left")
    return table.of(rows.withColumn(index.key, F.when(F.col(hit), F.lit(None)).otherwise(F.col(index.key))).select(*names))


def cascade(tables: dict[str, Table], indexes: dict[str, list[Index]], name: str, deleted: DataFrame) -> dict[str, Table]:
    """All tables after keys of one are deleted, following the declared references as far as they lead.

    Each reference is followed once for each level; a table that refers to itself is followed until nothing is left
    to delete, which takes a job per level.
    """
    out = dict(tables)
    todo = [(name, deleted)]
    while todo:
        parent, keys = todo.pop()
        out[parent] = delete(out[parent], keys.select(F.col(keys.columns[0]).alias(out[parent].key[0])))
        for child, specs in indexes.items():
            for index in specs:
                if index.related != parent:
                    continue
                before = out[child]
                if index.on_delete == "CASCADE":
                    lost = referrers(before, index, keys).select(*before.key).distinct()
                    if child == parent and lost.isEmpty():
                        continue
                    todo.append((child, lost))
                else:
                    out[child] = on_delete(before, index, keys)
    return out


def latest(changes: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key, by partial aggregation."""
    rest = [c for c in changes.columns if c not in key and c not in order]
    best = changes.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*(F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in changes.columns))


def with_previous(table: Table, new: DataFrame) -> DataFrame:
    """For triggers: key, old and new data of every row that a write touches, old null for inserts."""
    rest = [c for c in table.df.columns if c not in table.key]
    old = table.df.select(*table.key, F.struct(*rest).alias("old_data"))
    return new.select(*table.key, F.struct(*rest).alias("new_data")).join(old, list(table.key), "left")


@dataclass(frozen=True)
class Sequences:
    """Named sequences as a table of their state: name, next, low, high, step, wrap, gets. Each method gives a new table."""

    state: DataFrame

    SCHEMA = "name string, next long, low long, high long, step long, wrap boolean, gets long"

    def open(self, name: str, first: int = 0, step: int = 1, low: int = -(1 << 63), high: int = (1 << 63) - 1, wrap: bool = False) -> Sequences:
        """With the sequence, begun at first if it isn't there yet."""
        if not low <= first <= high or not step:
            raise ValueError("the first value must be within the limits, and the step not 0")
        new = self.state.sparkSession.createDataFrame([(name, first, low, high, step, wrap, 0)], self.SCHEMA)
        return Sequences(self.state.unionByName(new.join(self.state.select("name"), "name", "left_anti").select(*self.state.columns)))

    def take(self, name: str, count: int) -> tuple[Sequences, DataFrame]:
        """The table after count values, and the row of the first of them; running out raises an error when it is read."""
        hit = F.col("name") == F.lit(name)
        room = F.when(F.col("step") > 0, F.col("high") - F.col("next")).otherwise(F.col("next") - F.col("low"))
        after = F.col("next") + F.col("step") * count
        over = room < F.abs("step") * (count - 1)
        start = F.when(F.col("step") > 0, F.col("low")).otherwise(F.col("high"))
        value = F.when(~over, F.col("next")).when(F.col("wrap"), start).otherwise(F.raise_error(F.lit("the sequence has no more values")).cast("long"))
        left = F.when(~over, after).otherwise(start + F.col("step") * count)
        checked = F.when(over & ~F.col("wrap"), F.raise_error(F.lit("the sequence has no more values")).cast("long")).otherwise(left)
        state = self.state.withColumn("next", F.when(hit, checked).otherwise(F.col("next"))).withColumn("gets", F.col("gets") + hit.cast("long"))
        return Sequences(state.select(*self.state.columns)), self.state.where(hit).select("name", value.alias("value"), F.lit(count).cast("long").alias("count"))

    def remove(self, name: str) -> Sequences:
        return Sequences(self.state.where(F.col("name") != F.lit(name)))

    def stats(self, name: str) -> DataFrame:
        return self.state.where(F.col("name") == F.lit(name))
