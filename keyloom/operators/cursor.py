"""Lookups and movements in key order, each a query instead of a position."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Table, equals
from .ordered import at_place, neighbour, neighbour_key, numbered, running


def up(columns) -> list[Column]:
    return [F.col(c).asc() for c in columns]


def down(columns) -> list[Column]:
    return [F.col(c).desc() for c in columns]


def scan(table: Table, reverse: bool = False) -> DataFrame:
    """All rows in (reverse) order of key and data."""
    return table.df.orderBy(*(down if reverse else up)(table.order))


def at_least(columns, values, strict: bool = False) -> Column:
    """Whether the columns, compared in turn, are at or after (strict: after) the values."""
    left, right = F.struct(*columns), F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, values, strict=True)))
    return left > right if strict else left >= right


#: What an absolute kind compares with, and where a relative kind goes from no position at all.
RELATIVE = {"NEXT": "FIRST", "NEXT_NO_DUP": "FIRST", "PREV": "LAST", "PREV_NO_DUP": "LAST", "NEXT_DUP": None, "PREV_DUP": None, "CURRENT": None}


def get(table: Table, kind: str, key: tuple | None = None, data: tuple | None = None) -> DataFrame:
    """At most one row: FIRST, LAST, SEARCH, SEARCH_BOTH, SEARCH_GTE, SEARCH_BOTH_GTE, or a kind relative to a position.

    SEARCH takes the least data of the key. SEARCH_BOTH_GTE takes the least data of the key at or after `data`, and
    in a table without duplicates is SEARCH_BOTH, whose data are all other columns.

    CURRENT and the six movements take the position as key and data: the row there, or the one that the movement
    reaches from there, whether a row is at the position or not. Without a position NEXT and NEXT_NO_DUP are FIRST,
    PREV and PREV_NO_DUP are LAST, and the others have no meaning.
    """
    df, order = table.df, up(table.order)
    if kind in RELATIVE:
        if key is None:
            if RELATIVE[kind] is None:
                raise ValueError(f"{kind} needs a position")
            return get(table, RELATIVE[kind])
        return _beside(table, kind, key, data or ())
    if kind == "FIRST":
        return df.orderBy(*order).limit(1)
    if kind == "LAST":
        return df.orderBy(*down(table.order)).limit(1)
    if kind == "SEARCH":
        return df.where(table.key_is(*key)).orderBy(*order).limit(1)
    if kind == "SEARCH_GTE":
        return df.where(at_least(table.key, key)).orderBy(*order).limit(1)
    columns = table.data or tuple(c for c in df.columns if c not in table.key)
    columns = columns[: len(data)]
    if kind == "SEARCH_BOTH" or (kind == "SEARCH_BOTH_GTE" and not table.duplicates):
        return df.where(table.key_is(*key) & equals(columns, data)).orderBy(*order).limit(1)
    if kind == "SEARCH_BOTH_GTE":
        return df.where(table.key_is(*key) & at_least(columns, data)).orderBy(*order).limit(1)
    raise ValueError(f"unknown kind {kind}")


def _beside(table: Table, kind: str, key: tuple, data: tuple) -> DataFrame:
    here, columns = (*key, *data), table.order[: len(key) + len(data)]
    condition = {
        "CURRENT": lambda: equals(columns, here),
        "NEXT": lambda: at_least(columns, here, strict=True),
        "PREV": lambda: ~at_least(columns, here),
        "NEXT_DUP": lambda: table.key_is(*key) & at_least(columns, here, strict=True),
        "PREV_DUP": lambda: table.key_is(*key) & ~at_least(columns, here),
        "NEXT_NO_DUP": lambda: at_least(table.key, key, strict=True),
        "PREV_NO_DUP": lambda: ~at_least(table.key, key),
    }[kind]()
    return table.df.where(condition).orderBy(*(down if kind.startswith("PREV") else up)(table.order)).limit(1)


def move(table: Table, kind: str, into: str = "moved") -> DataFrame:
    """Every row with the row that NEXT, PREV, NEXT_DUP, PREV_DUP, NEXT_NO_DUP or PREV_NO_DUP reaches from it, null if none.

    NEXT_NO_DUP reaches the first row of the next key, PREV_NO_DUP the last row of the previous key. NEXT and PREV
    need a total order. The row reached is a struct of the key and data columns. No movement joins rows by key, so
    that a key of many rows meets in no task.
    """
    df, order = table.df, list(table.order)
    if kind in ("NEXT", "PREV"):
        return neighbour(df, order, into, order, kind == "NEXT")
    if kind in ("NEXT_DUP", "PREV_DUP"):
        rows = neighbour(df, order, into, order, kind == "NEXT_DUP")
        same = F.struct(*table.key) == F.struct(*(F.col(f"{into}.{c}").alias(c) for c in table.key))
        return rows.withColumn(into, F.when(same, F.col(into)))
    if kind in ("NEXT_NO_DUP", "PREV_NO_DUP"):
        return neighbour_key(df, list(table.key), order, into, kind == "NEXT_NO_DUP")
    raise ValueError(f"unknown kind {kind}")


def first_of_keys(table: Table) -> DataFrame:
    """The first row of each key, by partial aggregation, so that a key of many rows meets in no task."""
    return _edge_of_keys(table, F.min)


def last_of_keys(table: Table) -> DataFrame:
    return _edge_of_keys(table, F.max)


def _edge_of_keys(table: Table, best) -> DataFrame:
    rest = [c for c in table.df.columns if c not in table.order]
    row = F.struct(*table.data, *rest) if table.data or rest else F.struct(F.lit(0).alias("_none"))
    out = table.df.groupBy(*table.key).agg(best(row).alias("_row"))
    return out.select(*(F.col(c) if c in table.key else F.col(f"_row.{c}").alias(c) for c in table.df.columns))


def skip(table: Table, count: int, start: tuple | None = None, forward: bool = True) -> DataFrame:
    """Moves over up to count rows from the row of key `start` (or from before the first, after the last).

    One row with `moved`, the rows moved over, and the row landed on; none if there is nothing to move to.
    """
    df = table.df
    if start is not None:
        df = df.where(at_least(table.key, start, strict=True) if forward else ~at_least(table.key, start))
    if count <= 0:
        return df.limit(0).withColumn("moved", F.lit(0).cast("long"))
    return at_place(df, list(table.order), count, not forward)


class RangeError(ValueError):
    """A sub-range reaches outside its parent."""


@dataclass(frozen=True)
class KeyRange:
    """Bounds of one key column; None is open."""

    begin: object = None
    begin_inclusive: bool = True
    end: object = None
    end_inclusive: bool = True

    def check_begin(self, value, inclusive: bool = True) -> bool:
        return self.begin is None or value > self.begin or (value == self.begin and (self.begin_inclusive or not inclusive))

    def check_end(self, value, inclusive: bool = True) -> bool:
        return self.end is None or value < self.end or (value == self.end and (self.end_inclusive or not inclusive))

    def check(self, value, inclusive: bool = True) -> bool:
        return self.check_begin(value, inclusive) and self.check_end(value, inclusive)

    def sub_range(self, begin=None, begin_inclusive: bool = True, end=None, end_inclusive: bool = True) -> KeyRange:
        """A range within this one; open bounds are inherited, and bounds outside raise RangeError."""
        for value, inclusive in ((begin, begin_inclusive), (end, end_inclusive)):
            if value is not None and not self.check(value, inclusive):
                raise RangeError(f"{value!r} is outside of {self}")
        b = (self.begin, self.begin_inclusive) if begin is None else (begin, begin_inclusive)
        e = (self.end, self.end_inclusive) if end is None else (end, end_inclusive)
        if b[0] is not None and e[0] is not None and b[0] > e[0]:
            raise RangeError(f"{b[0]!r} is after {e[0]!r}")
        return KeyRange(*b, *e)

    def single(self, value) -> KeyRange:
        return self.sub_range(value, True, value, True)

    def condition(self, column: str | Column) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        out = F.lit(True)
        if self.begin is not None:
            out = out & (c >= F.lit(self.begin) if self.begin_inclusive else c > F.lit(self.begin))
        if self.end is not None:
            out = out & (c <= F.lit(self.end) if self.end_inclusive else c < F.lit(self.end))
        return out


def in_range(table: Table, bounds: KeyRange) -> Table:
    """The table's rows whose (first) key column is within bounds; the filter reaches the scan."""
    return table.of(table.df.where(bounds.condition(table.key[0])))


def within(table: Table, bounds: KeyRange, data: KeyRange | None = None) -> Table:
    """A cursor's range: the key within bounds, and (as for primary keys under a secondary one) the first data column too.

    get() and move() on it stay inside: LAST is the last row in the range, with duplicates the last of the last key.
    """
    condition = bounds.condition(table.key[0])
    return table.of(table.df.where(condition if data is None else condition & data.condition(table.data[0])))


def with_prefix(table: Table, prefix: str) -> Table:
    return table.of(table.df.where(F.col(table.key[0]).startswith(prefix)))


def constrained(table: Table, start: tuple, condition: Column) -> DataFrame:
    """Rows from key `start` on, up to the first row for which the condition fails."""
    rows = table.df.where(at_least(table.key, start)).withColumn("_ok", F.coalesce(condition, F.lit(False)))
    stop = rows.where(~F.col("_ok")).orderBy(*up(table.order)).limit(1).select(F.struct(*table.order).alias("_stop"))
    ends = rows.join(F.broadcast(stop), F.lit(True), "left")
    return ends.where(F.col("_stop").isNull() | (F.struct(*table.order) < F.col("_stop"))).drop("_ok", "_stop")


__all__ = ["KeyRange", "RangeError", "at_least", "constrained", "first_of_keys", "get", "in_range", "last_of_keys", "move", "numbered", "running", "scan", "skip", "with_prefix", "within"]
