"""Tables with declared keys, and the indexes derived from them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Relate = Literal["ONE_TO_ONE", "MANY_TO_ONE", "ONE_TO_MANY", "MANY_TO_MANY"]
OnDelete = Literal["ABORT", "CASCADE", "NULLIFY"]


@dataclass(frozen=True)
class Table:
    """A DataFrame in key order. data: the columns that order rows of one key (sorted duplicates); none if keys are unique."""

    df: DataFrame
    key: tuple[str, ...]
    data: tuple[str, ...] = ()

    @property
    def order(self) -> tuple[str, ...]:
        return self.key + self.data

    @property
    def duplicates(self) -> bool:
        return bool(self.data)

    def of(self, df: DataFrame) -> Table:
        return Table(df, self.key, self.data)

    def key_is(self, *values) -> Column:
        return equals(self.key, values)


@dataclass(frozen=True)
class Index:
    """A secondary key: a column or expression of the table; an array for the TO_MANY kinds. Null keys are not indexed."""

    name: str
    key: str | Column
    relate: Relate = "MANY_TO_ONE"
    related: str | None = None
    on_delete: OnDelete = "ABORT"
    only: Column | None = field(default=None, compare=False)
    immutable: bool = False  # whether a write may never change a row's key

    @property
    def column(self) -> Column:
        return F.col(self.key) if isinstance(self.key, str) else self.key

    @property
    def many(self) -> bool:
        return self.relate in ("ONE_TO_MANY", "MANY_TO_MANY")

    @property
    def unique(self) -> bool:
        return self.relate in ("ONE_TO_ONE", "ONE_TO_MANY")


def free(name: str, *frames: DataFrame) -> str:
    """name, or name with underscores after it if one of the frames has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def equals(columns: tuple[str, ...], values: tuple) -> Column:
    out = F.lit(True)
    for c, v in zip(columns, values, strict=True):
        out = out & (F.col(c) == F.lit(v))
    return out
