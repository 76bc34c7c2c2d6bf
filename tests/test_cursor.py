from __future__ import annotations

import itertools
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keyloom.model import Table
from keyloom.operators import cursor
from keyloom.operators.cursor import KeyRange, RangeError

PAIRS = sorted({(k, d) for k in (1, 3, 4, 9) for d in (2, 5, 7)} | {(6, 1)})


@pytest.fixture(scope="module")
def dups(spark):
    rows = PAIRS[:]
    random.Random(3).shuffle(rows)
    return Table(spark.createDataFrame(rows, "k int, d int").repartition(3), ("k",), ("d",))


def one(df):
    rows = df.collect()
    assert len(rows) <= 1
    return (rows[0].k, rows[0].d) if rows else None


def test_lookups(dups):
    for k, d in itertools.product(range(11), range(9)):
        at_key = [p for p in PAIRS if p[0] == k]
        if d == 0:
            assert one(cursor.get(dups, "SEARCH", (k,))) == (at_key[0] if at_key else None)
            assert one(cursor.get(dups, "SEARCH_GTE", (k,))) == next((p for p in PAIRS if p[0] >= k), None)
        if k in (1, 2, 6):
            assert one(cursor.get(dups, "SEARCH_BOTH", (k,), (d,))) == ((k, d) if (k, d) in PAIRS else None)
            assert one(cursor.get(dups, "SEARCH_BOTH_GTE", (k,), (d,))) == next((p for p in at_key if p[1] >= d), None)
    assert one(cursor.get(dups, "FIRST")) == PAIRS[0] and one(cursor.get(dups, "LAST")) == PAIRS[-1]


def test_both_gte_without_duplicates_is_exact(spark):
    t = Table(spark.createDataFrame([(1, 5), (2, 7)], "k int, d int"), ("k",))
    assert one(cursor.get(t, "SEARCH_BOTH_GTE", (1,), (4,))) is None
    assert one(cursor.get(t, "SEARCH_BOTH_GTE", (1,), (5,))) == (1, 5)


@pytest.mark.parametrize("kind", ["NEXT", "PREV", "NEXT_DUP", "PREV_DUP", "NEXT_NO_DUP", "PREV_NO_DUP"])
def test_moves(dups, kind):
    got = {(r.k, r.d): tuple(r.moved)[:2] if r.moved else None for r in cursor.move(dups, kind).collect()}
    for p in PAIRS:
        after, before = [q for q in PAIRS if q > p], [q for q in PAIRS if q < p][::-1]
        want = {
            "NEXT": after,
            "PREV": before,
            "NEXT_DUP": [q for q in after if q[0] == p[0]],
            "PREV_DUP": [q for q in before if q[0] == p[0]],
            "NEXT_NO_DUP": [q for q in after if q[0] != p[0]],
            "PREV_NO_DUP": [q for q in before if q[0] != p[0]],
        }[kind]
        assert got[p] == (want[0] if want else None), p


@pytest.mark.parametrize("kind", ["NEXT", "PREV", "NEXT_DUP", "PREV_DUP", "NEXT_NO_DUP", "PREV_NO_DUP"])
@pytest.mark.parametrize("keys", [500, 7, 2])
def test_moves_over_ranges(spark, kind, keys, monkeypatch):
    """Many rows, of which one key has most: the ranges cut it."""
    monkeypatch.setattr("keyloom.operators.ordered.SAMPLED", 5)
    r = random.Random(keys)
    pairs = sorted({(0 if r.random() < 0.4 else r.randrange(keys), r.randrange(3000)) for _ in range(1500)})
    mixed = pairs[:]
    r.shuffle(mixed)
    t = Table(spark.createDataFrame(mixed, "k int, d int").repartition(3), ("k",), ("d",))
    got = {(x.k, x.d): tuple(x.moved) if x.moved else None for x in cursor.move(t, kind).collect()}
    step = 1 if kind.startswith("NEXT") else -1
    walk = pairs[::step]
    want, target = {}, None
    for i, p in enumerate(walk[::-1]):  # from the end of the movement
        before = walk[::-1][i - 1] if i else None
        if kind.endswith("NO_DUP"):
            if before is not None and before[0] != p[0]:
                target = before
            want[p] = target
        else:
            want[p] = before if not kind.endswith("DUP") or (before and before[0] == p[0]) else None
    if kind.endswith("NO_DUP"):  # the row reached is the one of its key that the movement meets first
        want = {p: next((q for q in walk if (q[0] - p[0]) * step > 0), None) for p in pairs}
    assert got == want


def test_neighbours_by_time_and_null(spark, monkeypatch):
    monkeypatch.setattr("keyloom.operators.ordered.SAMPLED", 5)
    df = spark.range(600).selectExpr("if(id % 9 = 0, null, timestamp_micros(id * 1234567)) as t", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, id / 7.0) as n", "-id as d", "id")
    for key in (["t", "id"], ["n"], ["d"]):
        t = Table(df.repartition(3), tuple(key))
        rows = sorted(df.collect(), key=lambda r: tuple((r[k] is not None, r[k]) for k in key))
        want = {a.id: b[key[-1]] for a, b in zip(rows, rows[1:])} | {rows[-1].id: None}
        assert {r.id: r.moved[key[-1]] if r.moved else None for r in cursor.move(t, "NEXT").collect()} == want


def test_skip(spark):
    t = Table(spark.createDataFrame([(i,) for i in range(10)], "k int"), ("k",))
    for count, start, forward in itertools.product((0, 1, 4, 20), (None, 3, 9, 50), (True, False)):
        keys = list(range(10)) if forward else list(range(10))[::-1]
        if start is not None:
            keys = [k for k in keys if (k > start if forward else k < start)]
        got = cursor.skip(t, count, None if start is None else (start,), forward).collect()
        keys = keys[:count]
        assert [(r.k, r.moved) for r in got] == ([(keys[-1], len(keys))] if keys else [])


KEYS = [b"\x01", b"\xff", b"\xff\x00", b"\xff\x7f", b"\xff\xff", b"\xff\xff\x00", b"\xff\xff\x7f", b"\xff\xff\xff"]


def test_ranges_of_bytes(spark):
    t = Table(spark.createDataFrame([(bytearray(k),) for k in KEYS], "k binary"), ("k",))
    bounds = [None, b"\x00", *KEYS[:4], b"\xff\xff\xff\xff"]
    for b, e, bi, ei in itertools.product(bounds, bounds, (True, False), (True, False)):
        r = KeyRange(b, bi, e, ei)
        assert [k for k in KEYS if r.check(k)] == [k for k in KEYS if (b is None or k > b or (bi and k == b)) and (e is None or k < e or (ei and k == e))]
    r = KeyRange(KEYS[1], False, KEYS[4], True)
    assert sorted(bytes(x.k) for x in cursor.in_range(t, r).df.collect()) == KEYS[2:5]


def test_sub_ranges():
    r = KeyRange(10, True, 20, False)
    assert r.sub_range(12, False) == KeyRange(12, False, 20, False)
    for bad in ((9, True, None, True), (None, True, 20, True), (15, True, 12, True)):
        with pytest.raises(RangeError):
            r.sub_range(*bad)
    assert r.sub_range(end=20, end_inclusive=False) == r and r.single(10).check(10)


def test_constraint_stops(spark):
    t = Table(spark.createDataFrame([(i, i % 5) for i in range(12)], "k int, v int"), ("k",))
    assert sorted(r.k for r in cursor.constrained(t, (5,), F.col("v") < 3).collect()) == [5, 6, 7]


def test_numbers_over_partitions(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "k int").repartition(7)
    got = {r.k: (r.rn, r.s) for r in cursor.running(cursor.numbered(df, ["k"]), ["k"], F.col("k"), "s").collect()}
    total = 0
    for n, v in enumerate(sorted(values), 1):
        total += v
        assert got[v] == (n, total)


FIRST_TABLE = """
from pyspark.sql import SparkSession, functions as F
from keyloom.model import Table
from keyloom.operators import cursor, ordered
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.range(2000).select((F.col("id") % 300).alias("a"), "id")
assert "AS a#1L" in rows._jdf.queryExecution().analyzed().toString()
ordered.SAMPLED = 5
pairs = sorted((i % 300, i) for i in range(2000))
got = cursor.numbered(rows, ["a", "id"]).collect()
assert sorted(tuple(r) for r in got) == [(*p, n + 1) for n, p in enumerate(pairs)]
t = Table(rows, ("a",), ("id",))
for kind, beside in (("NEXT", pairs[1:] + [None]), ("PREV", [None] + pairs[:-1])):
    assert sorted((r.a, r.id, tuple(r.moved) if r.moved else None) for r in cursor.move(t, kind).collect()) == [(*p, q) for p, q in zip(pairs, beside)], kind
for kind, step in (("NEXT_NO_DUP", 1), ("PREV_NO_DUP", -1)):
    assert all((r.moved.a if r.moved else None) == (r.a + step if 0 <= r.a + step < 300 else None) for r in cursor.move(t, kind).collect()), kind
"""


def test_key_is_second_column_of_first_table():
    """In a process of its own: ids of columns count from the session's first."""
    run = subprocess.run([sys.executable, "-c", FIRST_TABLE], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
