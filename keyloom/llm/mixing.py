"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, written

#: Over so many sources, their table is joined by shuffling instead of being broadcast.
BROADCAST_SOURCES = 100_000
#: Buckets of a distributed running total: at most so many besides one for each source, of so many rows at least.
BUCKETS, BUCKET_ROWS = 20_000, 256


def source_targets(sized: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """One row per source: its rank, rows, size, and its target of the total.

    Sources take the weights in turn, by code point, null last. A target that would exceed max_repeats times its
    source's size stops there, and the others share the excess by weight, until none is above.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    src = src.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    turn = F.array(*(F.lit(w).cast("long") for w in weights))
    src = src.withColumn("weight", F.element_at(turn, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", max_repeats * F.col("source_size"))
    by_room = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "rank")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    src = src.withColumn("total", F.sum("source_size").over(everything))
    src = src.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    src = src.withColumn("open_level", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level")))
    level = F.first("open_level", ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    src = src.withColumn("share", level * F.col("weight"))
    return src.select("source", "rank", "n_rows", "source_size", "total", F.when(F.col("cap") <= F.col("share"), F.col("cap").cast("double")).otherwise(F.col("share")).alias("target"))


def shuffle_key(id_col: Column, seed: str) -> Column:
    """A place in 0 .. 2^32 - 1 that depends on the id and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def _with_sources(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    side = sources.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(side) if small else side, rows["source"].eqNullSafe(side["_source"])).drop("_source")


def _plan(sized: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: str) -> tuple[DataFrame, bool]:
    """Per source: source_size, target, and for each round through the source the last place that the mix takes."""
    src = written(source_targets(sized, weights, max_repeats), "sources")
    n_sources, n_rows = src.select(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    small = n_sources <= BROADCAST_SOURCES
    per = max(BUCKET_ROWS, -(-n_rows // BUCKETS))
    rows = sized.where("size > 0").select("source", "size", "id", shuffle_key(F.col("id"), seed).alias("place"))
    rows = _with_sources(rows, src, small).withColumn("bucket", F.shiftright(F.col("place") * F.ceil(F.col("n_rows") / per), 32))
    sums = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("rank").alias("_rank"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("rank", "bucket").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("size").over(inside))
    rows = rows.join(sums, (rows["rank"] == sums["_rank"]) & (rows["bucket"] == sums["_bucket"]))
    queued = written(rows.select("rank", "source_size", "target", "total", "size", "place", "id", (F.col("_before") + F.col("_in")).alias("through")), "queued")

    bins = max(1, -(-n_rows // per))
    items = queued.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    items = items.withColumn("finish", (F.col("round") * F.col("source_size") + F.col("through")) / F.col("target")).where("finish <= 2")
    items = items.withColumn("bin", F.floor(F.col("finish") * bins))
    hist = items.groupBy("bin").agg(F.sum("size").alias("_sum"), F.first("total").alias("total"))
    hist = hist.withColumn("through", F.sum("_sum").over(Window.orderBy("bin")))
    cut = hist.where("through > total").orderBy("bin").select("bin", (F.col("total") - F.col("through") + F.col("_sum")).alias("room")).first()
    if cut is not None:  # only this bin is sorted item by item
        order = Window.orderBy("finish", "rank", "place", "id", "round").rowsBetween(Window.unboundedPreceding, 0)
        last = items.where(F.col("bin") == cut["bin"]).withColumn("_run", F.sum("size").over(order))
        last = last.where(F.col("_run") <= cut["room"]).drop("_run")
        items = items.where(F.col("bin") < cut["bin"]).unionByName(last)
    ends = items.groupBy("rank").agg(*(F.max(F.when(F.col("round") == r, F.struct("place", "id"))).alias(f"_end{r}") for r in range(max_repeats)))
    ends = src.join(ends.withColumnRenamed("rank", "_rank"), F.col("rank") == F.col("_rank"), "left").drop("_rank")
    return written(ends, "ends"), small


def words_of(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long")


def _decide(rows: DataFrame, id_col: str, source_col: str, size_col: str, into: tuple[str, str, str], sized: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: str) -> DataFrame:
    """rows with the columns `into`: source_size, target and the times that the mix takes the row. No other column is touched."""
    ends, small = _plan(sized, weights, max_repeats, seed)
    at, source, plan = (free(n, rows) for n in ("_at", "_source", "_plan"))
    side = ends.select(F.col("source").alias(source), F.struct("source_size", "target", *(f"_end{r}" for r in range(max_repeats))).alias(plan))
    names = [F.col(f"`{c}`") for c in rows.columns]
    placed = rows.withColumn(at, F.struct(shuffle_key(F.col(f"`{id_col}`"), seed).alias("place"), F.col(f"`{id_col}`").alias("id")))
    placed = placed.join(F.broadcast(side) if small else side, F.col(f"`{source_col}`").eqNullSafe(F.col(source)))
    taken = sum((F.coalesce(F.col(at) <= F.col(f"{plan}._end{r}"), F.lit(False)).cast("int") for r in range(max_repeats)), F.lit(0))
    repeats = F.when(F.col(f"`{size_col}`") > 0, taken).otherwise(0)
    return placed.select(*names, F.col(f"{plan}.source_size").alias(into[0]), F.col(f"{plan}.target").alias(into[1]), repeats.alias(into[2]))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), words_of(text_col).alias("size")), "sized")


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """The id, size (words), source_size, target (of its source) and taken (words that the mix takes of it) for each row of docs.

    Each source queues its rows in the order of a hash of seed and id, again and again up to max_repeats times. A
    row's virtual finish time is the words queued through it divided by its source's target; the mix takes rows in
    order of finish time while its words stay within the words of all docs. Ties of finish time go by source, place and id.

    Null and empty texts have size 0, and rows of size 0 are never taken; texts of any length count whole; null is a
    source of its own; rows repeated with the same id count each and are taken alike. An empty table gives an empty
    result. Each text is read once. Other columns of docs, whatever their names, play no part. One row per source is
    broadcast, up to BROADCAST_SOURCES.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    out = _decide(sized, "id", "source", "size", ("source_size", "target", "repeats"), sized, weights, max_repeats, seed)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    seed: str = "mix",
) -> DataFrame:
    """The mix itself: docs' rows and columns, whatever their names, each as often as the mix takes it; all else as mix_plan()."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    size, a, b, repeats, copy = (free(n, docs) for n in ("_size", "_a", "_b", "_repeats", "_copy"))
    rows = docs.withColumn(size, words_of(text_col))
    plan = _decide(rows, id_col, source_col, size, (a, b, repeats), _sized(docs, id_col, text_col, source_col), weights, max_repeats, seed)
    return plan.where(F.col(repeats) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(repeats)))).select(*names)
