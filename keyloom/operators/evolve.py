"""Schema evolution: versioned lists of column changes, widening, and rows without a schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import written

#: The types that each type widens to, in order.
WIDER = {
    "tinyint": ("smallint", "int", "bigint", "float", "double", "decimal"),
    "smallint": ("int", "bigint", "float", "double", "decimal"),
    "int": ("bigint", "float", "double", "decimal"),
    "bigint": ("float", "double", "decimal"),
    "float": ("double",),
}


class IncompatibleError(TypeError):
    """A stored type can't become the wanted one without a declared conversion."""


@dataclass(frozen=True)
class Rename:
    old: str
    new: str


@dataclass(frozen=True)
class Drop:
    name: str


@dataclass(frozen=True)
class Convert:
    name: str
    to: Callable[[Column], Column]


@dataclass(frozen=True)
class RenameType:
    """The class of the rows has another name from the next version on."""

    new: str


@dataclass(frozen=True)
class DropType:
    """Rows of the class are gone from the next version on."""


@dataclass(frozen=True)
class ConvertRow:
    """All fields at once: a function from the old columns to the new row, and old index keys that fall with it."""

    to: Callable[[DataFrame], DataFrame]
    deleted_keys: tuple[str, ...] = ()


Mutation = Rename | Drop | Convert | RenameType | DropType | ConvertRow


def evolve(df: DataFrame, version: int, mutations: dict[int, list[Mutation]]) -> DataFrame:
    """Rows of a version under the changes declared for it and each later one, in order; a view, not a rewrite."""
    for v in sorted(k for k in mutations if k >= version):
        for m in mutations[v]:
            if isinstance(m, RenameType):
                continue
            if isinstance(m, DropType):
                df = df.limit(0)
                continue
            if isinstance(m, ConvertRow):
                if missing := [k for k in m.deleted_keys if k not in df.columns]:
                    raise IncompatibleError(f"version {v} has no key {missing[0]}")
                df = m.to(df)
                if kept := [k for k in m.deleted_keys if k in df.columns]:
                    raise IncompatibleError(f"{kept[0]} is deleted, but version {v} converts rows to it")
                continue
            name = m.old if isinstance(m, Rename) else m.name
            if name not in df.columns:
                raise IncompatibleError(f"version {v} has no field {name}")
            if isinstance(m, Rename):
                df = df.withColumnRenamed(m.old, m.new)
            elif isinstance(m, Drop):
                df = df.drop(m.name)
            else:
                df = df.withColumn(m.name, m.to(F.col(m.name)))
    return df


def type_name(name: str, version: int, mutations: dict[int, list[Mutation]]) -> str | None:
    """What a class of a version is called now; None if it was dropped."""
    for v in sorted(k for k in mutations if k >= version):
        for m in mutations[v]:
            if isinstance(m, DropType):
                return None
            if isinstance(m, RenameType):
                name = m.new
    return name


def eager(versions: dict[int, DataFrame], mutations: dict[int, list[Mutation]], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """All rows written under the present schema, and for each version n_read and n_converted: the rows that it changed."""
    current = max(versions)
    marked = None
    for v, df in sorted(versions.items()):
        one = widen(evolve(df, v, mutations), schema).withColumn("_version", F.lit(v))
        marked = one if marked is None else marked.unionByName(one)
    rows = written(marked, "evolved")
    counts = rows.groupBy(F.col("_version").alias("version")).agg(F.count("*").alias("n_read"))
    return rows.drop("_version"), counts.withColumn("n_converted", F.when(F.col("version") == current, 0).otherwise(F.col("n_read")).cast("long"))


def model(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row per field of the tables of a store: type, field, field_type, is_key, place."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, f.name, f.dataType.simpleString(), f.name in keys.get(n, ()), i) for n, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "type string, field string, field_type string, is_key boolean, place int")


def raw_values(df: DataFrame, fields: dict[str, str], column: str = "raw") -> DataFrame:
    """Fields of rows without a schema, by name and type; other columns stay, a field that a row lacks is null."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *(F.get_json_object(column, f"$.{n}").cast(t).alias(n) for n, t in fields.items()))


def widens(old: str, new: str) -> bool:
    return old == new or new.split("(")[0] in WIDER.get(old, ())


def widen(df: DataFrame, schema: T.StructType, keys: tuple[str, ...] = ()) -> DataFrame:
    """df under a schema: fields widened where that is allowed, new fields null, missing ones dropped; keys keep their type."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        old, new = df.schema[f.name].dataType.simpleString(), f.dataType.simpleString()
        if old != new and (f.name in keys or not widens(old, new)):
            raise IncompatibleError(f"{f.name}: {old} can't become {new}")
        out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


def merged(versions: dict[int, DataFrame], mutations: dict[int, list[Mutation]], schema: T.StructType) -> DataFrame:
    """Rows of all stored versions under the present schema."""
    out = None
    for v, df in sorted(versions.items()):
        one = widen(evolve(df, v, mutations), schema)
        out = one if out is None else out.unionByName(one)
    return out


def raw(df: DataFrame, into: str = "raw") -> DataFrame:
    """Each row as a JSON object of its fields."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(into))


def from_raw(df: DataFrame, schema: T.StructType, column: str = "raw") -> DataFrame:
    return df.select(F.from_json(column, schema).alias("_row")).select("_row.*")
