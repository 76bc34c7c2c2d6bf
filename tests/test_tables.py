from __future__ import annotations

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom import storage
from keyloom.functions import codec
from keyloom.model import Index, Table
from keyloom.operators import diff, dml, evolve, index, ttl, views
from keyloom.plans import catalog
from keyloom.sources import dump, stats
from keyloom.sources.store import ExistsError, Store
from keyloom.streaming import cdc


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_index_join_truth_table(spark):
    t = Table(spark.createDataFrame([(i, 0, i % 2, i % 3) for i in range(5)], "id int, k1 int, k2 int, k3 int"), ("id",))
    for given, want in (((0, 0, 0), {0}), ((0, 0, 1), {4}), ((0, 0, None), {0, 2, 4}), ((None, 1, 1), {1}), ((None, 2, 2), set()), ((None, None, 2), {2})):
        conditions = [(Index(k, k), v) for k, v in zip(("k1", "k2", "k3"), given) if v is not None]
        assert {r.id for r in index.equality_join(t, conditions, True).collect()} == want
    with pytest.raises(ValueError):
        index.equality_join(t, [])


def test_relationships(spark):
    t = Table(spark.createDataFrame([(1, 5, [1, 2, 2]), (2, None, [2, None]), (3, 5, None)], "k int, one int, many array<int>"), ("k",))
    assert rows(index.view(t, Index("one", "one"))) == [(5, 1), (5, 3)]
    assert rows(index.view(t, Index("m", "many", "MANY_TO_MANY"))) == [(1, 1), (2, 1), (2, 2)]
    assert rows(index.unique_violations(t, Index("m", "many", "ONE_TO_MANY"))) == [(2, 2)]
    assert rows(index.unique_violations(t, Index("one", "one", "ONE_TO_ONE"))) == [(5, 2)]


def test_delete_actions(spark):
    t = Table(spark.createDataFrame([(1, 10, [10, 20]), (2, 20, [20]), (3, None, None)], "k int, ref int, refs array<int>"), ("k",))
    gone = spark.createDataFrame([(10,)], "id int")
    with pytest.raises(dml.ConstraintError):
        dml.on_delete(t, Index("r", "ref"), gone)
    assert {r.k for r in dml.on_delete(t, Index("r", "ref", on_delete="CASCADE"), gone).df.collect()} == {2, 3}
    assert rows(dml.on_delete(t, Index("r", "ref", on_delete="NULLIFY"), gone).df.select("k", "ref")) == [(1, None), (2, 20), (3, None)]
    assert rows(dml.on_delete(t, Index("r", "refs", "MANY_TO_MANY", on_delete="NULLIFY"), gone).df.select("k", "refs")) == [(1, [20]), (2, [20]), (3, None)]


def test_cascade_follows_itself(spark):
    t = Table(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "k int, boss int"), ("k",))
    out = dml.cascade({"e": t}, {"e": [Index("boss", "boss", related="e", on_delete="CASCADE")]}, "e", spark.createDataFrame([(1,)], "k int"))
    assert rows(out["e"].df.select("k")) == [(4,)]


def test_sequences(spark):
    t = Table(spark.createDataFrame([(i,) for i in range(10)], "k int"), ("k",))
    assert [r.s for r in dml.sequence(t, "s", 3, 2).orderBy("k").collect()] == list(range(3, 23, 2))
    assert [r.s for r in dml.sequence(t, "s", 5, -1, 0, 5, wrap=True).orderBy("k").collect()] == [5, 4, 3, 2, 1, 0, 5, 4, 3, 2]
    assert [r.s for r in dml.sequence(t, "s", 2, 3, 0, 9, wrap=True).orderBy("k").collect()] == [2, 5, 8, 0, 3, 6, 9, 0, 3, 6]
    with pytest.raises(PySparkException):
        dml.sequence(t, "s", 1, 1, 1, 5).collect()


def test_put_modes_without_and_with_duplicates(spark):
    t = Table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ("k",))
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(dml.put(t, new).df) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(dml.put(t, new, "NO_OVERWRITE").df) == [(1, "a"), (2, "b"), (3, "d")]
    with pytest.raises(ValueError):
        dml.put(t, new, "NO_DUP_DATA")
    d = Table(t.df, ("k",), ("v",))
    assert rows(dml.put(d, new).df) == [(1, "a"), (2, "b"), (2, "c"), (3, "d")]
    with pytest.raises(dml.ConstraintError):
        dml.put_current(d, (1,), v="z")


def test_map_and_list_views(spark):
    t = Table(spark.createDataFrame([(i, i * i) for i in range(10)], "k int, v int"), ("k",))
    m = views.MapView(t).sub_map(2, 7)
    assert rows(m.tail_map(4).key_set()) == [(4,), (5,), (6,)]
    assert m.contains_key(6) and not m.contains_key(7) and m.contains_value(F.col("v") == 9)
    assert rows(m.clear().table.df.select("k")) == [(0,), (1,), (7,), (8,), (9,)]
    with pytest.raises(PySparkException):
        m.put_all(spark.createDataFrame([(9, 1)], "k int, v int")).rows.collect()
    assert rows(views.ListView(t).get(3).select("k")) == [(3,)]


def test_ttl_with_a_given_clock(spark):
    day = 86_400_000
    df = spark.createDataFrame([(k, 5) for k in range(11)], "k int, at long").withColumn("expires_ms", ttl.expiration(F.col("at"), F.col("k")))
    for now in range(12):
        live = {r.k for r in ttl.live(df, now * day).collect()}
        assert live == {k for k in range(11) if k == 0 or k + 1 > now}


def test_regions(spark):
    a = Table(spark.createDataFrame([(i, 0) for i in range(20)], "k int, v int").repartition(5), ("k",))
    b = Table(spark.createDataFrame([(i, int(i in (3, 4, 10))) for i in range(20) if i != 11], "k int, v int"), ("k",))
    assert rows(diff.regions(a, b)) == [(1, 3, 4, 2), (2, 10, 11, 2)]
    assert views.equal(a.df, a.df.repartition(2)).first()["equal"] and not views.equal(a.df, b.df).first()["equal"]


def test_evolution(spark):
    old = spark.createDataFrame([(1, 7, "x")], "k long, n int, junk string")
    new = spark.createDataFrame([(2, 8.5)], "k long, size double")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("size", T.DoubleType())])
    mutations = {0: [evolve.Rename("n", "size"), evolve.Drop("junk")]}
    assert rows(evolve.merged({0: old, 1: new}, mutations, schema)) == [(1, 7.0), (2, 8.5)]
    with pytest.raises(evolve.IncompatibleError):
        evolve.widen(new, T.StructType([T.StructField("size", T.LongType())]))
    with pytest.raises(evolve.IncompatibleError):
        evolve.widen(old, T.StructType([T.StructField("n", T.LongType())]), ("n",))


@pytest.mark.parametrize("form", ["bytevalue", "print"])
def test_dump_round_trip(spark, tmp_path, form):
    t = Table(spark.createDataFrame([("a\\b", "é\t1"), ("", "\x01"), ("z", ""), ("null", None), ("\\N", "\\t\n")], "k string, v string"), ("k",))
    dump.write_dump(t, ["v"], f"{tmp_path}/d", form)
    loaded = dump.read_dump(spark, f"{tmp_path}/d").select(*(dump.fields_of(F.col(c))[0].alias(c) for c in ("key", "data")))
    assert rows(loaded) == rows(t.df)
    lines = dump.dump_lines(t, ["v"], form)
    with pytest.raises(dump.FormatError):
        dump.load_lines(lines.where("line != 'DATA=END'"))
    with pytest.raises(dump.FormatError):
        dump.load_lines(lines.where("line_no != 6").withColumn("line_no", F.when(F.col("line_no") > 6, F.col("line_no") - 1).otherwise(F.col("line_no"))))


def test_stats_projection(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "time int, Op_a int, Op_b int, Op int")
    assert stats.project(df, ["Op_", "time"]).columns == ["Op_a", "Op_b", "time"]
    assert stats.project(df, ["Op"]).columns == ["Op"]


def test_encodings_keep_order(spark):
    longs = [-(1 << 63), -5, -1, 0, 1, 255, 256, (1 << 63) - 1]
    got = spark.createDataFrame([(v,) for v in longs], "v long").select("v", codec.sorted_integer(F.col("v")).alias("b"))
    assert [r.v for r in got.orderBy("b").collect()] == longs
    assert rows(got.where(codec.read_sorted_integer(F.col("b")) != F.col("v"))) == []
    texts = ["", "\0", "a", "a\0b", "ab", "é", None]
    got = spark.createDataFrame([(v,) for v in texts], "v string").select("v", codec.sorted_string(F.col("v")).alias("b"))
    assert [r.v for r in got.orderBy("b").collect()] == ["", "a", "ab", "a\0b", "\0", "é", None]


def test_only_commits_count(spark):
    events = spark.createDataFrame(
        [(1, 1, "put", 7, "a"), (2, 2, "put", 7, "b"), (3, 1, "commit", None, None), (4, 2, "abort", None, None), (5, 3, "delete", 8, None), (6, 3, "commit", None, None), (7, 4, "put", 9, "open")],
        "seq long, txn long, op string, key long, value string",
    )
    base = spark.createDataFrame([(7, 0, "old"), (8, 0, "gone")], "key long, seq long, value string")
    assert rows(cdc.apply(base, cdc.committed(events))) == [(7, 1, "a")]


def test_stream_keeps_what_waits(spark, tmp_path):
    schema = "seq long, txn long, op string, key long, value double"
    folder = str(tmp_path)
    first = [(1, 1, "put", 5, 1.0), (2, 2, "put", 6, 2.0), (3, 2, "commit", None, None)]
    second = [(4, 1, "commit", None, None), (5, 3, "delete", 6, None), (6, 3, "commit", None, None)]
    for part in (first, second):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/events")
        cdc.replicate(spark, f"{folder}/events", schema, folder).awaitTermination()
    assert [(r.key, r.value) for r in cdc.state(spark, folder).collect()] == [(5, 1.0)]


def test_store_refuses(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.names() == []
    store.create("a", spark.range(3))
    with pytest.raises(PySparkException):
        store.create("a", spark.range(3))
    store.create("a", spark.range(4), exclusive=False)
    assert store.truncate("a") == 4 and store.open("a").count() == 0
    for bad in (lambda: store.open("b"), lambda: store.remove("b"), lambda: store.rename("b", "c"), lambda: store.rename("a", "a")):
        with pytest.raises(ExistsError):
            bad()


def test_written_tables_can_be_cleared(spark):
    storage.clear(spark)
    kept = storage.written(spark.range(5), "five")
    assert kept.count() == 5 and storage.clear(spark) == 1 and storage.clear(spark) == 0


def test_set_algebra_with_nulls(spark):
    left, right = (spark.createDataFrame([(x, y) for x, y in rows_], "k int, v string") for rows_ in ([(1, "a"), (None, "a"), (None, None), (None, None)], [(None, None), (1, None)]))
    assert rows(views.retain_all(left, right)) == [(None, None), (None, None)]
    assert rows(views.remove_all(left, right)) == [(1, "a"), (None, "a")]
    assert not views.contains_all(left, right).first()["contained"] and views.contains_all(left, right.where("k is null")).first()["contained"]


def test_disorder_is_found_in_what_is_stored(spark, tmp_path):
    spark.createDataFrame([(3,), (1,), (2,), (2,)], "k int").coalesce(1).write.parquet(f"{tmp_path}/t")
    t = diff.stored(spark.read.parquet(f"{tmp_path}/t"), "k")
    assert diff.disorder(t, "k").first()["out_of_order"] == 1
    assert rows(diff.misplaced(t, "k")) == [(2, 2)]


def test_bytes_not_characters(spark):
    df = spark.createDataFrame([("é12345",), ("a",), ("",)], "s string")
    assert [bytes(r.b).decode() for r in df.select(dml.partial_update("s", 2, 2, "X").alias("b")).collect()] == ["éX345", "a\0X", "\0\0X"]
    assert [bytes(r.b) for r in df.select(dml.partial_read("s", 1, 2).alias("b")).collect()] == ["é1".encode()[1:], b"", b""]


def test_a_key_put_twice(spark):
    t = Table(spark.createDataFrame([(1, "a")], "k int, v string"), ("k",))
    new = spark.createDataFrame([(1, "c", 2), (1, "b", 1), (2, "x", 1), (2, "x", 9)], "k int, v string, at int")
    assert rows(dml.put(t, new, order=("at",)).df) == [(1, "c"), (2, "x")]
    assert rows(dml.put(t.of(t.df.limit(0)), new, "NO_OVERWRITE", order=("at",)).df) == [(1, "b"), (2, "x")]
    with pytest.raises(PySparkException):
        dml.put(t, new).df.collect()
    assert rows(dml.put(t, new.where("k = 2")).df) == [(1, "a"), (2, "x")]


def test_sequence_tables(spark):
    s = dml.Sequences(spark.createDataFrame([], dml.Sequences.SCHEMA)).open("s", 5, 2, 0, 9).open("w", 8, 1, 0, 9, True)
    s, first = s.take("s", 3)
    assert rows(first) == [("s", 5, 3)] and s.stats("s").first()["next"] == 11
    with pytest.raises(PySparkException):
        s.take("s", 1)[1].collect()
    assert s.take("w", 3)[1].first()["value"] == 0
    assert rows(s.remove("s").state.select("name")) == [("w",)]


def test_header_lines_that_are_unknown(spark):
    lines = ["VERSION=3", "format=print", "own=1", "HEADER=END", " k", " v", "DATA=END"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    with pytest.raises(dump.FormatError):
        dump.load_lines(df)
    assert rows(dump.load_lines(df, ignore_unknown=True)) == [("k", "v")]
    with pytest.raises(dump.FormatError):
        dump.load_pairs(df)


def test_log_that_begins_too_late(spark):
    events = spark.createDataFrame([(5,), (6,)], "seq long")
    assert cdc.require_sequence(events, 6).count() == 1
    with pytest.raises(cdc.LogOverwrittenError):
        cdc.require_sequence(events, 2)


def test_negative_or_unknown_time_to_live(spark):
    df = spark.createDataFrame([(0, -1)], "at long, t int")
    with pytest.raises(ValueError):
        ttl.expiration(F.col("at"), F.col("t"), "WEEKS")
    with pytest.raises(PySparkException):
        df.select(ttl.expiration(F.col("at"), F.col("t"))).collect()


def test_types_and_rows_evolve(spark):
    mutations = {0: [evolve.RenameType("B")], 2: [evolve.DropType()]}
    assert evolve.type_name("A", 0, mutations) is None and evolve.type_name("A", 0, {0: mutations[0]}) == "B" and evolve.type_name("A", 3, mutations) == "A"
    df = spark.createDataFrame([(1, 2)], "k int, old int")
    assert evolve.evolve(df, 0, mutations).count() == 0
    with pytest.raises(evolve.IncompatibleError):
        evolve.evolve(df, 0, {0: [evolve.ConvertRow(lambda x: x, ("old",))]})
    fields = evolve.model({"t": df}, {"t": ("k",)})
    assert [(r.field, r.is_key) for r in fields.orderBy("place").collect()] == [("k", True), ("old", False)]


def test_blocks_that_agree_are_left_out(spark):
    a = Table(spark.range(3000).selectExpr("id as k", "id % 7 as v"), ("k",))
    b = a.of(a.df.withColumn("v", F.when(F.col("k") == 1500, 9).otherwise(F.col("v"))))
    assert rows(diff.blocks(a, b, 1000).where("not equal").select("block")) == [(1,)]
    assert rows(diff.block_records(a, b, 1000)) == [(1500, "different")]


def test_store_for_reading_and_truncating(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.create("rows", spark.range(3))
    store.create("by_x", spark.range(3))
    assert store.truncate_with("rows", ["by_x"]) == 3 and store.open("by_x").count() == 0
    closed = Store(spark, f"file://{tmp_path}/s", read_only=True)
    for bad in (lambda: closed.create("c", spark.range(1)), lambda: closed.remove("rows"), lambda: closed.rename("rows", "r")):
        with pytest.raises(ExistsError):
            bad()


def agrees_on_events(spark, folder, name, times):
    """Whether a query of events at these times returns what its SQL does."""
    made = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(times)], "event_id long, ts string, user_id long")
    made.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/events.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        want = db.execute(catalog.SQL[name]).fetchall()
    got = catalog.QUERIES[name](spark, str(folder))
    return len(want) > 0 and rows(got) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["ttl_hours", "ttl_days"])
def test_times_within_a_millisecond_of_a_unit(spark, tmp_path, name):
    """Half a millisecond after a full hour counts as a whole one, so that the next hour is the row's."""
    part = ("000000", "000001", "000499", "000500", "000501", "000999", "001000", "001499", "001500")
    times = [f"2024-01-{day} {hour}:00:00.{us}" for day in (14, 15, 16) for hour in ("00", "07", "23") for us in part]
    before = [f"2024-01-{day} {hour}:59:59.{us}" for day in (14, 15, 16) for hour in ("06", "23") for us in ("999", "999499", "999500", "999999")]
    assert agrees_on_events(spark, tmp_path, name, times + before)


@pytest.mark.parametrize("name", ["ttl_units", "ttl_hours", "ttl_histogram"])
def test_times_before_1970(spark, tmp_path, name):
    """Units are divisions of integers that cut toward zero."""
    days = ("1964-02-29", "1968-12-31", "1969-12-30", "1969-12-31", "1970-01-01", "2024-01-15")
    times = [f"{day} {time}" for day in days for time in ("00:00:00", "00:00:00.0005", "00:00:00.001", "01:00:00", "12:34:56.7", "22:59:59.9985", "23:00:00", "23:59:59.9995", "23:59:59.9996")]
    assert agrees_on_events(spark, tmp_path, name, times)


def test_units_within_a_millisecond_of_an_hour(spark, tmp_path):
    part = ("000000", "000499", "000500", "000999", "001000")
    assert agrees_on_events(spark, tmp_path, "ttl_units", [f"2024-01-15 {hour:02}:00:00.{us}" for hour in range(24) for us in part])
