"""Change streams: events of transactions, of which only the committed count, applied by sequence number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dml import latest


def committed(events: DataFrame) -> DataFrame:
    """Put and delete events whose transaction has a commit event; aborted and open transactions fall.

    events: seq, txn, op (put, delete, commit, abort), key and any data columns.
    """
    done = events.where("op = 'commit'").select("txn").distinct()
    return events.where("op in ('put', 'delete')").join(done, "txn", "left_semi")


def net_changes(events: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last event of each key by sequence number."""
    return latest(events, (key,), (seq,))


def apply(base: DataFrame, changes: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """base after the net changes: put rows replace or add, delete rows remove. base has key, seq and the data columns."""
    net = net_changes(changes, key, seq)
    kept = base.join(net.select(key), key, "left_anti")
    return kept.unionByName(net.where("op = 'put'").select(*base.columns))


def of_tables(events: DataFrame, tables: list[str], column: str = "table") -> DataFrame:
    """A feeder's filter: the changes of some tables, and the ends of all transactions."""
    return events.where(F.col(column).isin(*tables) | F.col("op").isin("commit", "abort"))


def log_rows(events: DataFrame, ops: list[str] | None = None, keys: list | None = None, txns: list | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of a change log of given kinds, keys and transactions, within a range of sequence numbers; all filters reach the scan."""
    for column, some in (("op", ops), ("key", keys), ("txn", txns)):
        if some is not None:
            events = events.where(F.col(column).isin(*some))
    if first is not None:
        events = events.where(F.col("seq") >= first)
    return events if last is None else events.where(F.col("seq") <= last)


def transactions(events: DataFrame) -> DataFrame:
    """What transaction triggers would see: of each transaction its outcome (commit, abort or open) and its puts and deletes."""
    ends = F.max(F.when(F.col("op").isin("commit", "abort"), F.col("op")))
    n = lambda op: F.count(F.when(F.col("op") == op, 1))
    return events.groupBy("txn").agg(F.coalesce(ends, F.lit("open")).alias("outcome"), n("put").alias("n_put"), n("delete").alias("n_delete"))


class LogOverwrittenError(ValueError):
    """A subscriber asks for changes that the log no longer has."""


def require_sequence(events: DataFrame, first: int, seq: str = "seq") -> DataFrame:
    """from_sequence(), but an error if the log begins after `first`."""
    begin = events.agg(F.min(seq).alias("m")).first()["m"]
    if begin is not None and begin > first:
        raise LogOverwrittenError(f"the log begins at {begin}")
    return from_sequence(events, first, seq)


def callbacks(**by_kind: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that gives each kind's function (put, delete, commit, abort) the batch's rows of its kind."""

    def on_batch(batch: DataFrame, number: int) -> None:
        for kind, f in by_kind.items():
            f(batch.where(F.col("op") == kind))

    return on_batch


def from_sequence(events: DataFrame, first: int, seq: str = "seq") -> DataFrame:
    """Events from a sequence number on; the filter reaches the source."""
    return events.where(F.col(seq) >= first)


def triggers(base: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """What row triggers would see: key, old and new data of the net changes."""
    rest = [c for c in base.columns if c != key]
    old = base.select(key, F.struct(*rest).alias("old_data"))
    new = net_changes(changes).select(key, F.when(F.col("op") == "put", F.struct(*rest)).alias("new_data"))
    return new.join(old, key, "left")


def subscribe(spark: SparkSession, path: str, schema: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None], files: int = 1000) -> StreamingQuery:
    """Runs on_batch over what is new in a folder of event files, so many files a batch, then stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replicate(spark: SparkSession, path: str, schema: str, folder: str, files: int = 1000) -> StreamingQuery:
    """Keeps a log of committed changes and of events that wait for their commit under folder.

    Each batch joins its events with those that wait; a batch run again overwrites what it wrote. state(spark, folder)
    is the table that the log amounts to.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        waiting = batch
        if number > 0:
            waiting = batch.unionByName(spark.read.parquet(f"{folder}/open/batch={number - 1}"))
        ended = waiting.where("op in ('commit', 'abort')").select("txn").distinct()
        committed(waiting).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        waiting.join(ended, "txn", "left_anti").write.mode("overwrite").parquet(f"{folder}/open/batch={number}")

    return subscribe(spark, path, schema, f"{folder}/checkpoint", on_batch, files)


def state(spark: SparkSession, folder: str, key: str = "key", seq: str = "seq") -> DataFrame:
    return net_changes(spark.read.parquet(f"{folder}/log").drop("batch"), key, seq).where("op = 'put'")
