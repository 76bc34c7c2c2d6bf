"""Views of secondary keys, and the checks that such keys imply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Index, Table
from .cursor import KeyRange, at_least, up


def view(table: Table, index: Index) -> DataFrame:
    """(name, primary key) of every indexed row: one row per distinct secondary key of it."""
    rows = table.df if index.only is None else table.df.where(index.only)
    return keyed(rows, index, index.name, table.key)


def keyed(rows: DataFrame, index: Index, name: str, columns) -> DataFrame:
    """The columns of rows, once per distinct secondary key (none null), with the key as column `name` before them."""
    key = F.explode(F.array_distinct(index.column)) if index.many else index.column
    out = rows.select(key.alias(name), *(F.col(f"`{c}`") for c in columns if c != name))
    return out.where(F.col(f"`{name}`").isNotNull())


def _rows(table: Table, index: Index) -> DataFrame:
    return table.df if index.only is None else table.df.where(index.only)


def entities(table: Table, index: Index, bounds: KeyRange | None = None) -> DataFrame:
    """The primary rows by secondary key, once per key that leads to them, with the key as column `name`.

    One scan: the key of a row is in the row, so bounds filter the scan and nothing is joined.
    """
    rows = _rows(table, index)
    if bounds is not None and not index.many:
        rows = rows.where(bounds.condition(index.column))
    out = keyed(rows, index, index.name, table.df.columns)
    if bounds is not None and index.many:
        out = out.where(bounds.condition(index.name))
    return out if index.name not in table.df.columns else out.select(*table.df.columns)


def keys_index(table: Table, index: Index, bounds: KeyRange | None = None) -> DataFrame:
    """Secondary and primary keys alone; no other column is read."""
    out = view(table, index)
    return out if bounds is None else out.where(bounds.condition(index.name))


def sub_index(table: Table, index: Index, value, bounds: KeyRange | None = None) -> Table:
    """The primary rows of one secondary key, keyed by primary key: a filter on the scan."""
    rows = table.df.where(_holds(index, value))
    return table.of(rows if bounds is None else rows.where(bounds.condition(table.key[0])))


def first_entity(table: Table, index: Index, value) -> DataFrame:
    """The row of least primary key among those of a secondary key."""
    return sub_index(table, index, value).df.orderBy(*up(table.key)).limit(1)


def search(table: Table, index: Index, kind: str, value, primary: tuple | None = None) -> DataFrame:
    """SEARCH, SEARCH_GTE, SEARCH_BOTH and SEARCH_BOTH_GTE on (secondary key, primary key); the primary row, with the key."""
    name = f"{index.name}_key"
    rows = keyed(_rows(table, index), index, name, table.df.columns)
    here = F.col(name) == F.lit(value)
    condition = {
        "SEARCH": lambda: here,
        "SEARCH_GTE": lambda: F.col(name) >= F.lit(value),
        "SEARCH_BOTH": lambda: here & table.key_is(*primary),
        "SEARCH_BOTH_GTE": lambda: here & at_least(table.key, primary),
    }[kind]()
    return rows.where(condition).orderBy(name, *up(table.key)).limit(1)


def duplicate_counts(table: Table, index: Index) -> DataFrame:
    return view(table, index).groupBy(index.name).agg(F.count("*").alias("n"))


def unique_violations(table: Table, index: Index) -> DataFrame:
    """Secondary keys that lead to more than one row; a unique index must have none."""
    return duplicate_counts(table, index).where("n > 1")


def foreign_violations(table: Table, index: Index, related: Table) -> DataFrame:
    """Index entries whose key is not a primary key of the related table."""
    keys = view(table, index)
    return keys.join(related.df.select(F.col(related.key[0]).alias("_key")), F.col(index.name) == F.col("_key"), "left_anti")


def missing_entries(table: Table, index: Index, entries: DataFrame) -> DataFrame:
    """Entries that rows call for but a stored index lacks."""
    return view(table, index).join(entries, [index.name, *table.key], "left_anti")


def orphan_entries(table: Table, index: Index, entries: DataFrame) -> DataFrame:
    """Entries of a stored index that no row calls for."""
    return entries.join(view(table, index), [index.name, *table.key], "left_anti")


def entry_changes(before: Table, after: Table, index: Index) -> DataFrame:
    """What a write does to an index: entries to delete and to insert."""
    old, new = view(before, index), view(after, index)
    names = [index.name, *before.key]
    gone = old.join(new, names, "left_anti").withColumn("change", F.lit("delete"))
    return gone.unionByName(new.join(old, names, "left_anti").withColumn("change", F.lit("insert")))


def immutable_violations(before: Table, after: Table, index: Index) -> DataFrame:
    """Primary keys of rows that a write leaves but whose secondary key it changes, where the index says that none may."""
    if not index.immutable:
        return before.df.select(*before.key).limit(0)
    kept = entry_changes(before, after, index).select(*before.key).distinct()
    both = before.df.select(*before.key).join(after.df.select(*after.key), list(before.key), "left_semi")
    return kept.join(both, list(before.key), "left_semi")


def primary_rows(tables: dict[str, Table], entries: DataFrame) -> DataFrame:
    """The rows that entries of an index over several primaries lead to: each goes to the primary that it names.

    entries: as associated() gives them. An entry whose primary isn't there, or lacks the row, leads to nothing.
    """
    key = next(iter(tables.values())).key
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.df.withColumn("source_table", F.lit(n)) for n, t in tables.items()))
    return entries.join(rows, [*key, "source_table"])


def associated(tables: dict[str, Table], index: Index) -> DataFrame:
    """One index over several primaries: (name, key, source of the row)."""
    return reduce(DataFrame.unionByName, (view(t, index).withColumn("source_table", F.lit(n)) for n, t in tables.items()))


def of_kinds(table: Table, index: Index, kinds: list, column: str) -> Index:
    """The index of a subclass: only rows of these kinds have a key."""
    return Index(index.name, index.key, index.relate, index.related, index.on_delete, F.col(column).isin(*kinds))


def equality_join(table: Table, conditions: list[tuple[Index, object]], keys_only: bool = False) -> DataFrame:
    """Rows (or their keys) that have all the given secondary keys.

    A single-valued index is a filter on the row itself; a multi-valued one is a test of its array. So no index is
    shuffled, and one scan serves all conditions.
    """
    if not conditions:
        raise ValueError("a join needs a condition")
    condition = F.lit(True)
    for index, value in conditions:
        condition = condition & _holds(index, value)
    rows = table.df.where(condition)
    return rows.select(*table.key) if keys_only else rows


def _holds(index: Index, value) -> Column:
    out = F.array_contains(index.column, F.lit(value)) if index.many else index.column == F.lit(value)
    return out if index.only is None else out & index.only
