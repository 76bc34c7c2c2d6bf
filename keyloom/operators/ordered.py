"""Global order without a single task: ranges of keys, and a few numbers carried between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import free

#: Ranges for each shuffle partition, ranges in all at most, and rows of the sample for each range.
RANGES, MOST_RANGES, SAMPLED = 2, 4096, 40


def ordered(keys: list[str], reverse: bool = False) -> list[Column]:
    return [F.col(f"`{k}`").desc() if reverse else F.col(f"`{k}`").asc() for k in keys]


def cuts(df: DataFrame, keys: list[str]) -> list[tuple]:
    """Values of the first keys that cut df into ranges of like size, rising: MOST_RANGES at most, from a sample that bounds what reaches the driver.

    As many keys count as it takes to tell the cuts apart: one, unless one of its values fills ranges. A cut decides
    only where a range ends, so any sample gives the same result of whatever is computed over the ranges.
    """
    ranges = min(MOST_RANGES, RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    thin = df.select(*(F.col(f"`{k}`") for k in keys))
    n = thin.count()
    wanted = ranges * SAMPLED
    if n <= wanted:
        return []
    types = [df.schema[k].dataType for k in keys]
    some = thin.sample(min(1.0, wanted / n), 17).orderBy(*ordered(keys)).select(*(_out(F.col(f"`{k}`"), t).alias(k) for k, t in zip(keys, types))).collect()
    step = max(1, len(some) // ranges)
    chosen = some[step::step][:ranges]
    width = next((k for k in range(1, len(keys)) if len({r[:k] for r in chosen}) == len(chosen)), len(keys))
    return [r for r in dict.fromkeys(tuple(r[:width]) for r in chosen) if r != (None,)]


def _out(c: Column, kind: T.DataType) -> Column:
    """What stands for a value on the driver; times go as numbers or text, which no time zone changes."""
    return F.unix_micros(c) if isinstance(kind, T.TimestampType) else c.cast("string") if isinstance(kind, T.TimestampNTZType) else c


def _back(value, kind: T.DataType) -> Column:
    return F.timestamp_micros(F.lit(value)) if isinstance(kind, T.TimestampType) else F.lit(value).cast(kind)


def _value(keys: list[str], columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.struct(*(c.alias(k) for k, c in zip(keys, columns)))


@dataclass(frozen=True)
class Ranges:
    """df with the number of each row's range as column `part`. Nothing is written, and no column is read that isn't asked for.

    A range begins with the first row that has a cut's values; with `after`, it ends with the last one that has.
    """

    rows: DataFrame
    part: str
    keys: list[str]  # as many as the cuts have
    cuts: list[Column]
    here: Column

    def at_cuts(self) -> DataFrame:
        """The rows with a cut's values: few, and the scan can prune for them."""
        return self.rows.where(self.here.isin(*self.cuts))


def in_ranges(df: DataFrame, keys: list[str], after: bool = False) -> Ranges:
    part, at = free("_part", df), cuts(df, keys)
    keys = keys[: len(at[0])] if at else keys[:1]
    types = [df.schema[k].dataType for k in keys]
    values = [_value(keys, [_back(v, t) for v, t in zip(r, types)]) for r in at]
    here = _value(keys, [F.col(f"`{k}`") for k in keys])

    def count(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c < here if after else c <= here))

    if not at:
        number = F.pmod(F.xxhash64(F.lit(0)), F.lit(1)).cast("int")
    elif len(at) <= 64:
        number = count(F.array(*values))
    else:  # in two steps of about the square root of their number
        step = round(len(at) ** 0.5)
        block = count(F.array(*values[::step]))
        number = F.when(block == 0, 0).otherwise((block - 1) * step + count(F.slice(F.array(*values), (block - 1) * step + 1, step)))
    return Ranges(df.withColumn(part, number), part, keys, values, here)


def _same(part: str, near: str) -> Column:
    """Whether two rows are of one range. Of sums: where columns are equal, Spark 4.1 puts one's expression for the other.

    It then takes the key for the lambda's variable if the key has the id that it gives the latter, 1 (the second column
    of a session's first table), and filters by it where there is no key.
    """
    return F.col(part) + 1 == F.col(near) + 1


def _beyond(r: Ranges, value: Column, order: Column, forward: bool, near: str, into: str) -> DataFrame:
    """For each range (near) the first row of the one after it, or with a backward movement the last of the one before it."""
    edges = r.at_cuts() if r.cuts else r.rows.limit(0)
    edges = edges.groupBy(r.part).agg((F.min_by if forward else F.max_by)(value, order).alias(into))
    return edges.select((F.col(r.part) + (-1 if forward else 1)).alias(near), into)


def neighbour(df: DataFrame, keys: list[str], into: str, values: list[str], forward: bool = True) -> DataFrame:
    """df with `into`: the struct of `values` of the next (or the previous) row in the order of keys, null at the end.

    Inside a range it is a window; the first (last) row of the range after (before) is one of the rows at a cut.
    """
    r = in_ranges(df, keys, after=not forward)
    inside, beyond, near = (free(n, r.rows) for n in ("_inside", "_beyond", "_near"))
    value, key = F.struct(*(F.col(f"`{v}`").alias(v) for v in values)), F.struct(*(F.col(f"`{k}`") for k in keys))
    edges = _beyond(r, value, key, forward, near, beyond)
    window = Window.partitionBy(r.part).orderBy(*ordered(keys, not forward))
    out = r.rows.withColumn(inside, F.lead(value).over(window)).join(F.broadcast(edges), _same(r.part, near), "left")
    return out.withColumn(into, F.coalesce(inside, beyond)).drop(inside, beyond, near, r.part)


def neighbour_key(df: DataFrame, key: list[str], order: list[str], into: str, forward: bool = True) -> DataFrame:
    """df with `into`: of the next key its first row (of the previous key its last), as the struct of `order`, null at the end.

    Windows run against the direction of the movement, so that each needs only what it has passed. Where no key fills
    ranges, each range begins with a key of its own. A key of very many rows is cut as well; then a table of one row per
    range carries rows from range to range.
    """
    r = in_ranges(df, order, after=not forward)
    turn, beyond, near, inside = (free(n, r.rows) for n in ("_turn", "_beyond", "_near", "_inside"))
    here, row = F.struct(*(F.col(f"`{k}`").alias(k) for k in key)), F.struct(*(F.col(f"`{k}`").alias(k) for k in order))
    against = Window.partitionBy(r.part).orderBy(*ordered(order, forward))
    following = F.lead(here).over(against)
    rows = r.rows.withColumn(turn, F.when(following.isNotNull() & ~following.eqNullSafe(here), row))
    passed = F.last(turn, ignorenulls=True).over(against.rowsBetween(Window.unboundedPreceding, -1))
    if not r.cuts or len(r.keys) <= len(key):
        edges = _beyond(r, row, row, forward, near, beyond)
    else:
        final, first = (F.min, F.max) if forward else (F.max, F.min)
        edges = rows.groupBy(F.col(r.part).alias(near)).agg(final(row).alias("final"), first(here).alias("first"), final(turn).alias("turn"))
        walk = Window.orderBy(F.col(near).desc() if forward else F.col(near).asc())
        after, last_key = F.lead("first").over(walk), F.struct(*(F.col(f"final.`{k}`").alias(k) for k in key))
        edges = edges.withColumn("entry", F.when(~last_key.eqNullSafe(after), F.col("final")).otherwise(F.col("turn")))
        edges = edges.select(near, F.last("entry", ignorenulls=True).over(walk.rowsBetween(Window.unboundedPreceding, -1)).alias(beyond))
    out = rows.withColumn(inside, passed).join(F.broadcast(edges), _same(r.part, near), "left")
    return out.withColumn(into, F.coalesce(inside, beyond)).drop(turn, inside, beyond, near, r.part)


def numbered(df: DataFrame, keys: list[str], into: str = "rn", reverse: bool = False) -> DataFrame:
    """df with each row's number, from 1, in a total order."""
    return running(df, keys, F.lit(1), into, reverse)


def running(df: DataFrame, keys: list[str], value: Column, into: str, reverse: bool = False) -> DataFrame:
    """df with the running sum of an integer value through each row in a total order."""
    held = free("_value", df)
    r = in_ranges(df.withColumn(held, value.cast("long")), keys)
    rows, part = r.rows, r.part
    near, earlier, within = (free(n, rows) for n in ("_near", "_earlier", "_within"))
    sums = rows.groupBy(F.col(part).alias(near)).agg(F.sum(held).alias("sum"))
    before = Window.orderBy(F.col(near).desc() if reverse else F.col(near).asc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sums = sums.select(near, F.coalesce(F.sum("sum").over(before), F.lit(0)).alias(earlier))
    window = Window.partitionBy(part).orderBy(*ordered(keys, reverse)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(within, F.sum(held).over(window)).join(F.broadcast(sums), _same(part, near))
    return out.withColumn(into, F.col(within) + F.col(earlier)).drop(held, within, earlier, near, part)


def at_place(df: DataFrame, keys: list[str], place: int, reverse: bool = False) -> DataFrame:
    """The row at a place (from 1) in a total order, or the last one if there are fewer, with its place as column `moved`.

    Counts by range tell which range holds it; only that range is sorted.
    """
    r = in_ranges(df, keys)
    rows, part = r.rows, r.part
    counts = sorted(((r[part], r["count"]) for r in rows.groupBy(part).count().collect()), reverse=reverse)  # MOST_RANGES rows at most
    place = min(place, sum(n for _, n in counts))
    before = 0
    for number, n in counts:
        if before + n >= place:
            break
        before += n
    else:
        return df.limit(0).withColumn("moved", F.lit(0).cast("long"))
    here = rows.where(F.col(part) == number).orderBy(*ordered(keys, reverse)).limit(place - before)
    return here.orderBy(*ordered(keys, not reverse)).limit(1).drop(part).withColumn("moved", F.lit(place).cast("long"))
