"""Helpers that the text operators share: shared storage, skew-safe lookups, chunked Arrow access."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import run_dir, shared_dir, written

__all__ = ["WORD", "chunks", "free", "hot_limit", "lookup", "map_arrow", "mix64", "run_dir", "shared_dir", "ship", "text_buffers", "written"]

WORD = r"[^\x20\x09-\x0D]+"

#: Hot keys are those with more than this share of the rows, so that there are at most so many of them.
HOT_KEYS = 100_000
#: Under so many rows a key is never hot.
HOT_ROWS = 50
#: A hot key's row of more bytes is not broadcast.
HOT_BYTES = 4096


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        target = f"{tempfile.mkdtemp(prefix='keyloom-')}/{top.name}.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, path.relative_to(top.parent))
        context.addPyFile(target)
        _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def hot_limit(total: int, keys: int = HOT_KEYS) -> int:
    """The rows that a key must exceed to be hot; at most `keys` keys do."""
    return max(HOT_ROWS, total // keys)


def free(name: str, *frames: DataFrame) -> str:
    """name, or name with underscores after it if one of the frames has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lookup(
    rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, spread: Column, into: str, most: int = HOT_KEYS, size: Column | None = None
) -> DataFrame:
    """rows with the matching row of table (one row per keys, columns besides the keys) as struct `into`, null where none.

    table's column `count` bounds the rows of each key. Keys over hot_limit(total, most), at most `most` of them, are
    broadcast, and the rows they match are spread over the partitions of the join that serves the others. `size` bounds
    the bytes of a row of table (fixed and small if not given); of hot keys with over HOT_BYTES only the number of copies is broadcast, and
    their row goes to that many places, between which the rows they match are dealt. rows may have any columns but `into`.
    """
    limit = hot_limit(total, most)
    values = [c for c in table.columns if c not in keys]
    own = [free(f"_k{i}", rows) for i in range(len(keys))]
    value, hot_value, places, place, at = (free(n, rows) for n in ("_v", "_hot", "_places", "_place", "_at"))
    side = table.select(*(F.col(k).alias(o) for k, o in zip(keys, own)), F.struct(*values).alias(value), (F.lit(0) if size is None else size).alias(at))
    n = F.col(f"{value}.{count}")
    small = F.col(at) <= HOT_BYTES
    wanted = F.when(small, 0).otherwise(F.ceil(n / max(1, limit)))
    hot = side.where(n > limit).select(*own, F.when(small, F.col(value)).alias(hot_value), wanted.cast("long").alias(places))
    # 0 for cold keys, but no constant: a constant would leave the join's keys, and the rows of hot keys would meet by key after all
    if size is None:
        cold = side.where(n <= limit).withColumn(at, F.pmod(n, F.lit(1)).cast("long"))
    else:
        cold = side.where((n <= limit) | ~small).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.when(n <= limit, 0).otherwise(F.ceil(n / max(1, limit)) - 1).cast("long"))))
    on = functools.reduce(lambda a, b: a & b, (rows[k] == hot[o] for k, o in zip(keys, own)))
    marked = rows.join(F.broadcast(hot), on, "left").drop(*own)
    served = functools.reduce(lambda a, b: a | b, (F.col(f"`{k}`").isNull() for k in keys), F.col(hot_value).isNotNull())
    dealt = F.xxhash64(spread)
    marked = marked.withColumn(place, F.when(served, -1 - F.pmod(dealt, F.lit(1 << 20))).when(F.col(places) > 0, F.pmod(dealt, F.col(places))).otherwise(F.lit(0)).cast("long"))
    on = functools.reduce(lambda a, b: a & b, (marked[k] == cold[o] for k, o in zip(keys, own)))
    joined = marked.join(cold, on & (marked[place] == cold[at]), "left")
    return joined.withColumn(into, F.coalesce(hot_value, value)).drop(hot_value, value, places, place, at, *own)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes, one row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
