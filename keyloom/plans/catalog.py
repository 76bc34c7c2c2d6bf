"""The registered queries over the driver's tables, and the SQL that says what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec
from ..model import Index, Table
from ..operators import cursor, diff, dml, evolve, index, joins, ttl, views
from ..operators.cursor import KeyRange
from ..sources import dump, scan, stats
from ..sources.store import Store
from ..storage import run_dir
from ..streaming import cdc

#: The time at which the queries of expiring rows ask.
NOW = 1_705_000_000_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LINE_DATA = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
_D = ", ".join(LINE_DATA)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return scan.table(spark, d, name)


def orders(spark: SparkSession, d: str) -> Table:
    return Table(read(spark, d, "orders"), ("o_orderkey",))


def customer(spark: SparkSession, d: str) -> Table:
    return Table(read(spark, d, "customer"), ("c_custkey",))


def lines(spark: SparkSession, d: str) -> Table:
    return Table(read(spark, d, "lineitem"), ("l_orderkey",), LINE_DATA)


def part(spark: SparkSession, d: str) -> Table:
    return Table(read(spark, d, "part"), ("p_partkey",))


def supplier(spark: SparkSession, d: str) -> Table:
    return Table(read(spark, d, "supplier"), ("s_suppkey",))


# Scans


@query("SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders")
def scan_ordered(spark, d):
    t = orders(spark, d)
    return cursor.numbered(t.df, list(t.order))


@query("SELECT *, row_number() OVER (ORDER BY o_orderkey DESC) AS rn FROM orders")
def scan_reverse(spark, d):
    t = orders(spark, d)
    return cursor.numbered(t.df, list(t.order), reverse=True)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem")
def scan_unordered(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT o_orderkey AS key FROM orders UNION ALL SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def scan_many(spark, d):
    return scan.scan_all([read(spark, d, n) for n in ("orders", "customer", "supplier")], ["o_orderkey", "c_custkey", "s_suppkey"])


@query("SELECT o_orderkey FROM orders")
def scan_keys_only(spark, d):
    return read(spark, d, "orders").select("o_orderkey")


@query("SELECT count(*) AS n FROM lineitem")
def count_db(spark, d):
    return scan.count_only(read(spark, d, "lineitem"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def scan_salvage(spark, d):
    return scan.salvage(read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT name, n FROM (SELECT 'backup' AS name, count(*) AS n FROM orders UNION ALL SELECT 'emptied', 0 UNION ALL SELECT 'renamed', (SELECT count(*) FROM orders))")
def store_tables(spark, d):
    """Tables created, renamed, truncated, copied and removed in a store; what is left, with its rows."""
    store = Store(spark, run_dir(spark, "store"))
    for name in ("first", "emptied", "gone"):
        store.create(name, read(spark, d, "orders"))
    store.rename("first", "renamed")
    store.truncate("emptied")
    store.remove("gone")
    store.create("backup", store.open("renamed"))
    counts = [store.open(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in store.names()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


# Lookups

_ORDER_BY = f"ORDER BY l_orderkey, {_D} LIMIT 1"


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def search_key(spark, d):
    return cursor.get(orders(spark, d), "SEARCH", (7,))


@query(f"SELECT * FROM lineitem WHERE l_orderkey = 33 {_ORDER_BY}")
def search_key_dups(spark, d):
    return cursor.get(lines(spark, d), "SEARCH", (33,))


@query(f"SELECT * FROM lineitem WHERE l_orderkey = 33 AND l_partkey = (SELECT max(l_partkey) FROM lineitem WHERE l_orderkey = 33) {_ORDER_BY}")
def search_both(spark, d):
    t = lines(spark, d)
    top = t.df.where("l_orderkey = 33").agg(F.max("l_partkey").alias("m")).first()["m"]
    return cursor.get(t, "SEARCH_BOTH", (33,), (top,))


@query("SELECT * FROM orders WHERE o_orderkey >= 1000 ORDER BY o_orderkey LIMIT 1")
def search_gte(spark, d):
    return cursor.get(orders(spark, d), "SEARCH_GTE", (1000,))


@query(f"SELECT * FROM lineitem WHERE l_orderkey = 33 AND (l_partkey, l_suppkey) >= (100, 5) {_ORDER_BY}")
def search_both_gte(spark, d):
    return cursor.get(lines(spark, d), "SEARCH_BOTH_GTE", (33,), (100, 5))


@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 1")
def get_first(spark, d):
    return cursor.get(orders(spark, d), "FIRST")


@query(f"SELECT * FROM lineitem ORDER BY l_orderkey DESC, {', '.join(c + ' DESC' for c in LINE_DATA)} LIMIT 1")
def get_last(spark, d):
    return cursor.get(lines(spark, d), "LAST")


@query("SELECT o_orderkey, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS moved FROM orders")
def next_key(spark, d):
    return cursor.move(orders(spark, d), "NEXT").select("o_orderkey", F.col("moved.o_orderkey").alias("moved"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS moved FROM orders")
def prev_key(spark, d):
    return cursor.move(orders(spark, d), "PREV").select("o_orderkey", F.col("moved.o_orderkey").alias("moved"))


def _moved(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.col("moved.l_orderkey").alias("to_order"), F.col("moved.l_partkey").alias("to_part"), F.col("moved.l_suppkey").alias("to_supp"))


def _moved_sql(inner: str) -> str:
    return f"SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, m.l_orderkey AS to_order, m.l_partkey AS to_part, m.l_suppkey AS to_supp FROM ({inner})"


_ROW = f"{{'l_orderkey': l_orderkey, {', '.join(f'{chr(39)}{c}{chr(39)}: {c}' for c in LINE_DATA)}}}"


@query(_moved_sql(f"SELECT *, lead({_ROW}) OVER (PARTITION BY l_orderkey ORDER BY {_D}) AS m FROM lineitem"))
def next_dup(spark, d):
    return _moved(cursor.move(lines(spark, d), "NEXT_DUP"))


@query(_moved_sql(f"SELECT *, lag({_ROW}) OVER (PARTITION BY l_orderkey ORDER BY {_D}) AS m FROM lineitem"))
def prev_dup(spark, d):
    return _moved(cursor.move(lines(spark, d), "PREV_DUP"))


@query(_moved_sql(f"SELECT l.*, n.m FROM lineitem l JOIN (SELECT l_orderkey, lead(e) OVER (ORDER BY l_orderkey) AS m FROM (SELECT l_orderkey, min({_ROW}) AS e FROM lineitem GROUP BY 1)) n USING (l_orderkey)"))
def next_no_dup(spark, d):
    return _moved(cursor.move(lines(spark, d), "NEXT_NO_DUP"))


@query(_moved_sql(f"SELECT l.*, n.m FROM lineitem l JOIN (SELECT l_orderkey, lag(e) OVER (ORDER BY l_orderkey) AS m FROM (SELECT l_orderkey, max({_ROW}) AS e FROM lineitem GROUP BY 1)) n USING (l_orderkey)"))
def prev_no_dup(spark, d):
    return _moved(cursor.move(lines(spark, d), "PREV_NO_DUP"))


@query("SELECT *, 100::BIGINT AS moved FROM orders WHERE o_orderkey > 50 ORDER BY o_orderkey LIMIT 1 OFFSET 99")
def skip_next(spark, d):
    return cursor.skip(orders(spark, d), 100, (50,))


@query("SELECT *, 20::BIGINT AS moved FROM orders WHERE o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 1 OFFSET 19")
def skip_prev(spark, d):
    return cursor.skip(orders(spark, d), 20, (500,), forward=False)


@query("SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < coalesce((SELECT min(o_orderkey) FROM orders WHERE o_orderkey >= 100 AND NOT o_totalprice < 450000), 1e18)")
def range_constraint(spark, d):
    return cursor.constrained(orders(spark, d), (100,), F.col("o_totalprice") < 450000)


@query("SELECT * FROM customer WHERE c_acctbal BETWEEN 6000 AND 8000")
def range_incl(spark, d):
    t = customer(spark, d)
    return index.entities(t, Index("c_acctbal", "c_acctbal"), KeyRange(6000.0, True, 8000.0, True))


@query("SELECT * FROM customer WHERE c_custkey > 100 AND c_custkey < 200")
def range_excl(spark, d):
    return cursor.in_range(customer(spark, d), KeyRange(100, False, 200, False)).df


@query("SELECT * FROM customer WHERE c_custkey >= 1000")
def range_open(spark, d):
    return cursor.in_range(customer(spark, d), KeyRange(1000)).df


@query("SELECT * FROM customer WHERE c_custkey > 150 AND c_custkey <= 300")
def range_sub(spark, d):
    return cursor.in_range(customer(spark, d), KeyRange(100, True, 400, False).sub_range(150, False, 300, True)).df


@query("SELECT * FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def prefix(spark, d):
    return cursor.with_prefix(Table(read(spark, d, "customer"), ("c_name",)), "Customer#0000001").df


@query("SELECT p_partkey, substr(p_name, 3, 4) AS piece FROM part")
def partial_read(spark, d):
    return read(spark, d, "part").select("p_partkey", dml.partial_read("p_name", 2, 4).cast("string").alias("piece"))


@query("SELECT doc_id, substr(hex(encode(text)), 7, 14) AS piece FROM documents")
def partial_read_bytes(spark, d):
    """Bytes, also within a character of several."""
    return read(spark, d, "documents").select("doc_id", F.hex(dml.partial_read("text", 3, 7)).alias("piece"))


@query("SELECT * FROM orders WHERE o_orderkey = 33")
def get_current(spark, d):
    return cursor.get(orders(spark, d), "CURRENT", (33,))


@query("SELECT * FROM orders WHERE o_orderkey > 33 ORDER BY o_orderkey LIMIT 1")
def get_next(spark, d):
    return cursor.get(orders(spark, d), "NEXT", (33,))


@query("SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def get_prev_unset(spark, d):
    """PREV without a position is LAST."""
    return cursor.get(orders(spark, d), "PREV")


_DOWN = f"ORDER BY l_orderkey DESC, {', '.join(c + ' DESC' for c in LINE_DATA)} LIMIT 1"


@query(f"SELECT * FROM lineitem WHERE l_orderkey = 33 AND l_partkey < 1500 {_DOWN}")
def get_prev_dup(spark, d):
    return cursor.get(lines(spark, d), "PREV_DUP", (33,), (1500,))


@query(f"SELECT * FROM lineitem WHERE l_orderkey > 33 {_ORDER_BY}")
def get_next_no_dup(spark, d):
    return cursor.get(lines(spark, d), "NEXT_NO_DUP", (33,), (1500,))


@query(f"SELECT * FROM lineitem WHERE l_orderkey < 33 {_DOWN}")
def get_prev_no_dup(spark, d):
    return cursor.get(lines(spark, d), "PREV_NO_DUP", (33,), (1500,))


@query("SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500 ORDER BY o_orderkey DESC LIMIT 1")
def range_last(spark, d):
    return cursor.get(cursor.within(orders(spark, d), KeyRange(100, True, 500, False)), "LAST")


@query(f"SELECT * FROM lineitem WHERE l_orderkey BETWEEN 10 AND 33 AND l_partkey <= 900 {_DOWN}")
def range_last_dups(spark, d):
    """The last in a range of keys and of data: the last row of the last key that has one."""
    return cursor.get(cursor.within(lines(spark, d), KeyRange(10, True, 33, True), KeyRange(end=900)), "LAST")


@query("""WITH r AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 60 AND o_orderkey > 100)
SELECT o_custkey, o_orderkey, moved FROM r JOIN (SELECT o_custkey, lead(f) OVER (ORDER BY o_custkey) AS moved FROM (SELECT o_custkey, min(o_orderkey) AS f FROM r GROUP BY 1)) USING (o_custkey)""")
def range_moves(spark, d):
    """NEXT_NO_DUP on the index by customer, bounded by a range of keys and one of primary keys."""
    t = cursor.within(_by_customer(spark, d), KeyRange(10, True, 60, True), KeyRange(100, False))
    return cursor.move(t, "NEXT_NO_DUP").select("o_custkey", "o_orderkey", F.col("moved.o_orderkey").alias("moved"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus < o_orderpriority THEN -1 WHEN o_orderstatus > o_orderpriority THEN 1 ELSE 0 END AS compared FROM orders")
def compare_keys(spark, d):
    return read(spark, d, "orders").select("o_orderkey", codec.byte_compare(F.col("o_orderstatus").cast("binary"), F.col("o_orderpriority").cast("binary")).alias("compared"))


# Indexes


@query("SELECT o_custkey, o_orderkey FROM orders")
def idx_many_to_one(spark, d):
    return index.view(orders(spark, d), Index("o_custkey", "o_custkey"))


@query("SELECT o_custkey AS cust, o.* FROM orders o WHERE o_custkey BETWEEN 10 AND 60")
def idx_entities(spark, d):
    return index.entities(orders(spark, d), Index("cust", "o_custkey"), KeyRange(10, True, 60, True))


@query("SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey >= 5 AND c_nationkey < 9")
def idx_keys_only(spark, d):
    return index.keys_index(customer(spark, d), Index("c_nationkey", "c_nationkey"), KeyRange(5, True, 9, False))


@query("SELECT * FROM customer WHERE c_nationkey = 7 AND c_custkey >= 50")
def idx_sub(spark, d):
    return index.sub_index(customer(spark, d), Index("c_nationkey", "c_nationkey"), 7, KeyRange(50)).df


@query("SELECT * FROM orders WHERE o_custkey = 10 ORDER BY o_orderkey LIMIT 1")
def idx_first(spark, d):
    return index.first_entity(orders(spark, d), Index("o_custkey", "o_custkey"), 10)


@query("SELECT o.*, o_custkey AS o_custkey_key FROM orders o WHERE o_custkey >= 11 ORDER BY o_custkey, o_orderkey LIMIT 1")
def idx_search_gte(spark, d):
    return index.search(orders(spark, d), Index("o_custkey", "o_custkey"), "SEARCH_GTE", 11)


@query("SELECT o.*, o_custkey AS o_custkey_key FROM orders o WHERE o_custkey = 10 AND o_orderkey >= 500 ORDER BY o_orderkey LIMIT 1")
def idx_search_both_gte(spark, d):
    return index.search(orders(spark, d), Index("o_custkey", "o_custkey"), "SEARCH_BOTH_GTE", 10, (500,))


@query("SELECT o.*, o_custkey AS o_custkey_key FROM orders o WHERE o_custkey = 10 ORDER BY o_orderkey LIMIT 1")
def idx_search(spark, d):
    return index.search(orders(spark, d), Index("o_custkey", "o_custkey"), "SEARCH", 10)


@query("SELECT o.*, o_custkey AS o_custkey_key FROM orders o WHERE o_custkey = 10 AND o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_custkey = 10)")
def idx_search_both(spark, d):
    t = orders(spark, d)
    top = t.df.where("o_custkey = 10").agg(F.max("o_orderkey").alias("m")).first()["m"]
    return index.search(t, Index("o_custkey", "o_custkey"), "SEARCH_BOTH", 10, (top,))


@query("SELECT word, doc_id, lang FROM (SELECT doc_id, lang, unnest(list_distinct(string_split(text, ' '))) AS word FROM documents) WHERE word >= 'the' AND word < 'thf'")
def idx_multi_entities(spark, d):
    docs = Table(read(spark, d, "documents").select("doc_id", "lang", "text"), ("doc_id",))
    return index.entities(docs, Index("word", F.split("text", " "), "MANY_TO_MANY"), KeyRange("the", True, "thf", False)).drop("text")


@query("SELECT c_name, c_custkey FROM customer")
def idx_one_to_one(spark, d):
    return index.view(customer(spark, d), Index("c_name", "c_name", "ONE_TO_ONE"))


@query("SELECT word, doc_id FROM (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS word FROM documents)")
def idx_many_to_many(spark, d):
    docs = Table(read(spark, d, "documents"), ("doc_id",))
    return index.view(docs, Index("word", F.split("text", " "), "MANY_TO_MANY"))


@query("SELECT word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS word FROM documents) GROUP BY word")
def idx_dup_counts(spark, d):
    docs = Table(read(spark, d, "documents"), ("doc_id",))
    return index.duplicate_counts(docs, Index("word", F.split("text", " "), "MANY_TO_MANY"))


@query("SELECT user_id, event_id FROM events WHERE event_type IN ('purchase', 'signup')")
def idx_subclass(spark, d):
    events = Table(read(spark, d, "events"), ("event_id",))
    return index.view(events, index.of_kinds(events, Index("user_id", "user_id"), ["purchase", "signup"], "event_type"))


@query("SELECT o_orderpriority AS priority, o_orderkey FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'")
def idx_nulls(spark, d):
    return index.view(orders(spark, d), Index("priority", F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')")))


@query("SELECT c_nationkey AS nation, c_custkey AS id, 'customer' AS source_table FROM customer UNION ALL SELECT s_nationkey, s_suppkey, 'supplier' FROM supplier")
def idx_association(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"))
    return index.associated({"customer": Table(c, ("id",)), "supplier": Table(s, ("id",))}, Index("nation", "n"))


@query("SELECT c_nationkey AS nation, c_custkey AS id, c_name AS name, 'customer' AS source_table FROM customer WHERE c_nationkey = 3 UNION ALL SELECT s_nationkey, s_suppkey, s_name, 'supplier' FROM supplier WHERE s_nationkey = 3")
def idx_association_rows(spark, d):
    """The rows that a key of an index over two primaries leads to, each from its own primary."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.col("c_name").alias("name"))
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"), F.col("s_name").alias("name"))
    tables = {"customer": Table(c, ("id",)), "supplier": Table(s, ("id",))}
    entries = index.associated(tables, Index("nation", "n")).where("nation = 3")
    return index.primary_rows(tables, entries).select("nation", "id", "name", "source_table")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey % 7 <> 0 AND o_orderstatus <> 'F'")
def idx_immutable(spark, d):
    """Rows that a write leaves, but whose key it changes although the index forbids that."""
    t = orders(spark, d)
    after = t.of(t.df.where("o_orderkey % 7 != 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 0, "F").otherwise(F.col("o_orderstatus"))))
    return index.immutable_violations(t, after, Index("o_orderstatus", "o_orderstatus", immutable=True))


@query("SELECT o_orderstatus, o_orderkey, 'delete' AS change FROM orders WHERE o_orderkey % 100 = 0 AND o_orderstatus <> 'F' UNION ALL SELECT 'F', o_orderkey, 'insert' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderstatus <> 'F'")
def idx_maintenance(spark, d):
    t = orders(spark, d)
    after = t.of(t.df.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 0, "F").otherwise(F.col("o_orderstatus"))))
    return index.entry_changes(t, after, Index("o_orderstatus", "o_orderstatus"))


@query("SELECT line_key, count(*) AS n FROM (SELECT l_orderkey * 10 + l_linenumber AS line_key FROM lineitem) GROUP BY 1 HAVING count(*) > 1")
def unique_check(spark, d):
    return index.unique_violations(lines(spark, d), Index("line_key", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "ONE_TO_ONE"))


@query("SELECT o_custkey AS cust, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def fk_check(spark, d):
    c = customer(spark, d)
    return index.foreign_violations(orders(spark, d), Index("cust", "o_custkey", related="customer"), c.of(c.df.where("c_custkey % 7 != 0")))


@query("SELECT cust, o_orderkey FROM (SELECT o_custkey AS cust, o_orderkey FROM orders) WHERE cust IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def fk_abort_violations(spark, d):
    gone = customer(spark, d).df.where("c_nationkey = 3").select("c_custkey")
    return dml.referrers(orders(spark, d), Index("cust", "o_custkey", related="customer", on_delete="ABORT"), gone)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def fk_cascade(spark, d):
    specs = {"customer": [Index("nation", "c_nationkey", related="nation", on_delete="CASCADE")], "orders": [Index("cust", "o_custkey", related="customer", on_delete="CASCADE")]}
    tables = {"nation": Table(read(spark, d, "nation"), ("n_nationkey",)), "customer": customer(spark, d), "orders": orders(spark, d)}
    gone = tables["nation"].df.where("n_nationkey = 3").select("n_nationkey")
    return dml.cascade(tables, specs, "nation", gone)["orders"].df.select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (3, 4) THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def fk_nullify(spark, d):
    gone = read(spark, d, "nation").where("n_nationkey in (3, 4)").select("n_nationkey")
    out = dml.on_delete(customer(spark, d), Index("nation", "c_nationkey", related="nation", on_delete="NULLIFY"), gone)
    return out.df.select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, list_filter([c_nationkey, (c_nationkey + 1) % 25], lambda x: x NOT IN (3, 4)) AS refs FROM customer")
def fk_nullify_many(spark, d):
    """Deleted keys are taken out of arrays of references."""
    gone = read(spark, d, "nation").where("n_nationkey in (3, 4)").select("n_nationkey")
    rows = read(spark, d, "customer").select("c_custkey", F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 1) % 25).alias("refs"))
    return dml.on_delete(Table(rows, ("c_custkey",)), Index("ref", "refs", "MANY_TO_MANY", related="nation", on_delete="NULLIFY"), gone).df


def _by_customer(spark, d) -> Table:
    """The index of orders by customer as a table of its own: primary keys are its duplicates."""
    return Table(index.view(orders(spark, d), Index("o_custkey", "o_custkey")), ("o_custkey",), ("o_orderkey",))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rn FROM orders")
def idx_scan_ordered(spark, d):
    t = _by_customer(spark, d)
    return cursor.numbered(t.df, list(t.order))


@query("SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS moved FROM orders")
def idx_next_dup(spark, d):
    return cursor.move(_by_customer(spark, d), "NEXT_DUP").select("o_custkey", "o_orderkey", F.col("moved.o_orderkey").alias("moved"))


@query("SELECT o_custkey, o_orderkey, moved FROM orders JOIN (SELECT o_custkey, lag(top) OVER (ORDER BY o_custkey) AS moved FROM (SELECT o_custkey, max(o_orderkey) AS top FROM orders GROUP BY 1)) USING (o_custkey)")
def idx_prev_no_dup(spark, d):
    return cursor.move(_by_customer(spark, d), "PREV_NO_DUP").select("o_custkey", "o_orderkey", F.col("moved.o_orderkey").alias("moved"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 20")
def idx_large_keys(spark, d):
    return index.duplicate_counts(orders(spark, d), Index("o_custkey", "o_custkey")).where("n > 20")


@query("SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 5 AND 9 AND o_orderstatus = 'F'")
def join_range_and_index(spark, d):
    t = orders(spark, d)
    near = t.of(index.entities(t, Index("o_custkey", "o_custkey"), KeyRange(5, True, 9, True)))
    return index.equality_join(near, [(Index("s", "o_orderstatus"), "F")], keys_only=True)


# Joins and counts


@query("SELECT * FROM part WHERE p_brand = 'Brand#13' AND p_size = 10")
def join_eq2(spark, d):
    return index.equality_join(part(spark, d), [(Index("brand", "p_brand"), "Brand#13"), (Index("size", "p_size"), 10)])


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_custkey = 10")
def join_eq3(spark, d):
    return index.equality_join(orders(spark, d), [(Index("s", "o_orderstatus"), "F"), (Index("p", "o_orderpriority"), "1-URGENT"), (Index("c", "o_custkey"), 10)])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def join_keys(spark, d):
    return index.equality_join(orders(spark, d), [(Index("s", "o_orderstatus"), "F"), (Index("p", "o_orderpriority"), "1-URGENT")], keys_only=True)


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND lang = 'en'")
def join_multi_valued(spark, d):
    docs = Table(read(spark, d, "documents"), ("doc_id",))
    return index.equality_join(docs, [(Index("word", F.split("text", " "), "MANY_TO_MANY"), "the"), (Index("lang", "lang"), "en")], keys_only=True)


@query("SELECT c.* FROM customer c JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 5")
def join_dept_name(spark, d):
    nation = Table(read(spark, d, "nation"), ("n_nationkey",))
    return joins.related_rows(nation, F.col("n_nationkey") == 5, customer(spark, d), Index("nation", "c_nationkey"))


@query("SELECT s.* FROM supplier s JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def join_dept_loc(spark, d):
    nation = Table(read(spark, d, "nation"), ("n_nationkey",))
    return joins.related_rows(nation, F.col("n_regionkey") == 2, supplier(spark, d), Index("nation", "s_nationkey"))


@query("SELECT l_orderkey, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 45")
def join_through(spark, d):
    links = read(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey", "l_suppkey")
    return joins.through(part(spark, d), links, supplier(spark, d), "l_partkey", "l_suppkey").select("l_orderkey", "p_name", "s_name")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def count_dups(spark, d):
    return joins.duplicate_counts(lines(spark, d))


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey = 33")
def count_dups_at(spark, d):
    return joins.duplicate_count(lines(spark, d), (33,))


@query()
def count_estimate(spark, d):
    return joins.estimated_keys(lines(spark, d))


@query("""SELECT greatest(least(count(*), 1), 8 * count(*) FILTER (('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT % 8 = 0)) AS n FROM lineitem WHERE l_suppkey = 7""")
def count_estimate_at(spark, d):
    """About how many lines a supplier has, from a sample."""
    t = Table(read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ("l_suppkey",), ("l_orderkey", "l_linenumber"))
    return joins.estimated_duplicates(t, (7,), "l_orderkey")


@query("SELECT 'orders' AS name, count(*) AS n_rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def space_summary(spark, d):
    return joins.space(spark, {n: f"{d}/{n}.parquet" for n in ("orders", "lineitem", "events")}).where("files > 0 and bytes > 0").select("name", "n_rows")


@query("SELECT DISTINCT l_orderkey FROM lineitem")
def distinct_keys(spark, d):
    return joins.distinct_keys(lines(spark, d))


@query(f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_D}) = 1")
def first_of_keys(spark, d):
    return cursor.first_of_keys(lines(spark, d))


@query(f"SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in LINE_DATA)}) = 1")
def last_of_keys(spark, d):
    return cursor.last_of_keys(lines(spark, d))


# Views and set algebra


@query("SELECT min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders")
def map_bounds(spark, d):
    return joins.key_bounds(orders(spark, d)).select(F.col("first_key.o_orderkey").alias("first_key"), F.col("last_key.o_orderkey").alias("last_key"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 300")
def map_key_set(spark, d):
    return views.MapView(lines(spark, d)).sub_map(100, 300).key_set()


@query("SELECT count(*) AS n FROM lineitem WHERE l_orderkey < 300")
def map_size(spark, d):
    return views.MapView(lines(spark, d)).head_map(300).size()


@query(f"SELECT {_D} FROM lineitem WHERE l_orderkey = 33")
def map_duplicates(spark, d):
    return views.MapView(lines(spark, d)).duplicates(33)


@query("SELECT * FROM orders WHERE o_orderkey >= 1000")
def map_tail(spark, d):
    return views.MapView(orders(spark, d)).tail_map(1000).entry_set()


def _order_customers(spark, d, condition="true"):
    return read(spark, d, "orders").where(condition).select(F.col("o_custkey").alias("k")).distinct()


def _customers(spark, d, condition="true"):
    return read(spark, d, "customer").where(condition).select(F.col("c_custkey").alias("k"))


@query("SELECT count(*) = 0 AS contained FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)")
def set_contains_all(spark, d):
    return views.contains_all(_customers(spark, d), _order_customers(spark, d))


@query("SELECT c_custkey AS k FROM customer WHERE c_nationkey = 1 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def set_add_all(spark, d):
    return views.add_all(_customers(spark, d, "c_nationkey = 1"), _order_customers(spark, d, "o_totalprice > 400000"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_remove_all(spark, d):
    return views.remove_all(_customers(spark, d), _order_customers(spark, d, "o_totalprice > 300000"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_retain_all(spark, d):
    return views.retain_all(_customers(spark, d), _order_customers(spark, d, "o_totalprice > 300000"))


@query("SELECT (SELECT count(*) FROM ((SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders) UNION ALL (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer))) = 0 AS equal")
def set_equal(spark, d):
    return views.equal(_customers(spark, d), read(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT o_orderkey, rn - 1 AS index FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn BETWEEN 101 AND 150")
def list_sub_list(spark, d):
    t = orders(spark, d)
    return views.ListView(Table(t.df.select("o_orderkey"), t.key)).sub_list(100, 150)


@query("SELECT min(rn) - 1 AS index FROM (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE o_orderstatus = 'P'")
def list_index_of(spark, d):
    return views.ListView(orders(spark, d)).index_of(F.col("o_orderstatus") == "P")


def _with_null(name: str) -> str:
    return f"CASE WHEN {name} % 5 = 0 THEN NULL ELSE {name} END"


@query(f"SELECT count(*) = 0 AS contained FROM (SELECT {_with_null('o_custkey')} FROM orders EXCEPT SELECT {_with_null('c_custkey')} FROM customer)")
def set_contains_all_nulls(spark, d):
    """Null is an element as any other."""
    return views.contains_all(_customers(spark, d).selectExpr(f"{_with_null('k')} AS k"), _order_customers(spark, d).selectExpr(f"{_with_null('k')} AS k"))


@query(f"SELECT {_with_null('c_custkey')} AS k FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 AND o_custkey % 5 <> 0)")
def set_remove_all_nulls(spark, d):
    return views.remove_all(_customers(spark, d).selectExpr(f"{_with_null('k')} AS k"), _order_customers(spark, d, "o_totalprice > 300000").selectExpr(f"{_with_null('k')} AS k"))


@query(f"SELECT {_with_null('c_custkey')} AS k FROM customer WHERE c_custkey % 5 = 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def set_retain_all_nulls(spark, d):
    return views.retain_all(_customers(spark, d).selectExpr(f"{_with_null('k')} AS k"), _order_customers(spark, d, "o_totalprice > 300000").selectExpr(f"{_with_null('k')} AS k"))


@query("SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey = 33")
def map_get(spark, d):
    return views.MapView(orders(spark, d)).get(33)


@query("SELECT * FROM orders WHERE o_orderkey <> 33")
def map_remove(spark, d):
    return views.MapView(orders(spark, d)).tail_map(10).remove(33).remove(5).table.df


@query("SELECT * FROM orders WHERE NOT (o_orderkey = 33 AND o_orderstatus <> 'X') ")
def map_remove_value(spark, d):
    return views.MapView(orders(spark, d)).remove_value((33,), F.col("o_orderstatus") != "X").remove_value((34,), F.col("o_orderstatus") == "X").table.df


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 33 THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def map_replace_value(spark, d):
    m = views.MapView(orders(spark, d)).replace_value((33,), F.col("o_orderstatus") != "X", o_orderstatus="R")
    return m.replace_value((34,), F.col("o_orderstatus") == "X", o_orderstatus="R").table.df.select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderkey BETWEEN 100 AND 199 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def map_put_all(spark, d):
    t = orders(spark, d)
    t = t.of(t.df.select("o_orderkey", "o_orderstatus"))
    new = t.df.where("o_orderkey between 100 and 199").withColumn("o_orderstatus", F.lit("N"))
    return views.MapView(t).sub_map(100, 200).put_all(new).table.df


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 100 OR o_orderkey >= 200")
def map_clear(spark, d):
    return views.MapView(orders(spark, d)).sub_map(100, 200).clear().table.df.select("o_orderkey")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey < 300")
def map_value_set(spark, d):
    t = orders(spark, d)
    return views.MapView(t.of(t.df.select("o_orderkey", "o_orderstatus", "o_orderpriority"))).head_map(300).value_set()


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey = 33 AND o_orderkey < 300) > 0 AS has_key, (SELECT count(*) FROM orders WHERE o_orderkey < 300 AND o_orderstatus = 'X') > 0 AS has_value")
def map_contains(spark, d):
    m = views.MapView(orders(spark, d)).head_map(300)
    return m.rows.limit(1).select(F.lit(m.contains_key(33)).alias("has_key"), F.lit(m.contains_value(F.col("o_orderstatus") == "X")).alias("has_value"))


_LIST = "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders"


def _list(spark, d) -> views.ListView:
    return views.ListView(Table(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ("o_orderkey",)))


@query(f"SELECT o_orderkey, CASE WHEN index = 7 THEN 'L' ELSE o_orderstatus END AS o_orderstatus, index FROM ({_LIST})")
def list_set(spark, d):
    return _list(spark, d).set(7, o_orderstatus="L")


@query(f"SELECT o_orderkey, o_orderstatus, index + CASE WHEN index >= 7 THEN 25 ELSE 0 END AS index FROM ({_LIST}) UNION ALL SELECT n_nationkey, n_name, 6 + row_number() OVER (ORDER BY n_nationkey) FROM nation")
def list_insert(spark, d):
    """All of another list put in at a position."""
    new = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("o_orderkey"), F.col("n_name").alias("o_orderstatus"))
    return _list(spark, d).insert(7, views.ListView(Table(new, ("o_orderkey",))))


@query(f"SELECT o_orderkey, o_orderstatus, index - CASE WHEN index >= 7 THEN 3 ELSE 0 END AS index FROM ({_LIST}) WHERE index NOT IN (7, 8, 9)")
def list_remove(spark, d):
    return _list(spark, d).remove(7, 3)


# Writes


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN 'KEYEXIST' ELSE 'SUCCESS' END AS status, false AS is_update FROM orders WHERE o_orderkey % 5 = 0")
def put_status(spark, d):
    return dml.put_status(*_split(spark, d), "NO_OVERWRITE")


@query("SELECT k AS l_orderkey, CASE WHEN n > 0 THEN 'SUCCESS' ELSE 'NOTFOUND' END AS status, n FROM (SELECT k, (SELECT count(*) FROM lineitem WHERE l_orderkey = k) AS n FROM (SELECT o_orderkey * 3 AS k FROM orders WHERE o_orderkey % 9 = 0))")
def delete_status(spark, d):
    return dml.delete_status(lines(spark, d), read(spark, d, "orders").where("o_orderkey % 9 = 0").select((F.col("o_orderkey") * 3).alias("l_orderkey")))


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def put_latest(spark, d):
    """All events put by user in their order: of several rows of one key the last stays."""
    e = read(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    empty = Table(e.drop("event_id").limit(0), ("user_id",))
    return dml.put(empty, e, order=("event_id",)).df


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def put_assigned(spark, d):
    """Rows without key get one when they are put."""
    t = Table(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ("id",))
    new = read(spark, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, 0).cast("long").alias("id"), F.col("n_name").alias("name"))
    return dml.put_assigned(t, new).df


@query("SELECT o_orderkey, CASE WHEN o_custkey < 100 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_rows(spark, d):
    return dml.update_rows(orders(spark, d), F.col("o_custkey") < 100, o_totalprice=F.col("o_totalprice") * 2).df.select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, rpad(substr(hex(encode(text)), 1, 10), 10, '0') || '58595A' || substr(hex(encode(text)), 17) AS bytes FROM documents")
def partial_update_bytes(spark, d):
    return read(spark, d, "documents").select("doc_id", F.hex(dml.partial_update("text", 5, 3, "XYZ")).alias("bytes"))


def _split(spark, d) -> tuple[Table, DataFrame]:
    """Orders but for each tenth, and new rows: each fifth with another status."""
    t = orders(spark, d)
    t = t.of(t.df.select("o_orderkey", "o_custkey", "o_orderstatus"))
    return t.of(t.df.where("o_orderkey % 10 != 0")), t.df.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("N"))


_BASE = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0"
_NEW = "SELECT o_orderkey, o_custkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 5 = 0"


@query(f"{_BASE} AND o_orderkey % 5 <> 0 UNION ALL {_NEW}")
def put_overwrite(spark, d):
    return dml.put(*_split(spark, d)).df


@query(f"{_BASE} UNION ALL {_NEW} AND o_orderkey % 10 = 0")
def put_no_overwrite(spark, d):
    return dml.put(*_split(spark, d), "NO_OVERWRITE").df


@query("SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def put_no_dup_data(spark, d):
    pairs = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return dml.put(Table(pairs.where("v % 3 != 0"), ("k",), ("v",)), pairs.where("v % 2 = 0"), "NO_DUP_DATA").df


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = 33 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def put_current(spark, d):
    t = orders(spark, d)
    return dml.put_current(t.of(t.df.select("o_orderkey", "o_custkey", "o_orderstatus")), (33,), o_orderstatus="X").df


@query("SELECT n.o_orderkey, b.o_orderstatus AS previous_status FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) n LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) b USING (o_orderkey)")
def put_returning(spark, d):
    return dml.put_returning(*_split(spark, d)).select("o_orderkey", F.col("previous.o_orderstatus").alias("previous_status"))


@query(f"{_BASE} AND o_orderkey % 5 <> 0 UNION ALL {_NEW} AND o_orderkey % 10 <> 0")
def put_replace(spark, d):
    return dml.replace(*_split(spark, d)).df


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0")
def delete_keys(spark, d):
    t, new = _split(spark, d)
    return dml.delete(orders(spark, d), new).df.select("o_orderkey")


@query("SELECT o_custkey AS k, o_orderkey AS v FROM orders WHERE o_orderkey % 2 <> 0")
def delete_pairs(spark, d):
    pairs = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return dml.delete(Table(pairs, ("k",), ("v",)), pairs.where("v % 2 = 0"), both=True).df


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def delete_by_index(spark, d):
    gone = read(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey")
    return dml.delete_by_index(customer(spark, d), Index("nation", "c_nationkey"), gone).df.select("c_custkey")


@query("SELECT p_partkey, substr(p_name, 1, 2) || 'XYZ' || substr(p_name, 7) AS p_name FROM part")
def partial_update(spark, d):
    return read(spark, d, "part").select("p_partkey", dml.partial_update("p_name", 2, 4, "XYZ").cast("string").alias("p_name"))


@query("SELECT c_custkey, 1000 + (row_number() OVER (ORDER BY c_custkey) - 1) * 5 AS seq FROM customer")
def sequence_assign(spark, d):
    return dml.sequence(customer(spark, d), "seq", 1000, 5).select("c_custkey", "seq")


@query("SELECT c_custkey, 1 + (row_number() OVER (ORDER BY c_custkey) - 1) % 97 AS seq FROM customer")
def sequence_wrap(spark, d):
    return dml.sequence(customer(spark, d), "seq", 1, 1, 1, 97, wrap=True).select("c_custkey", "seq")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def append_rows(spark, d):
    t = Table(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ("id",))
    return dml.append(t, read(spark, d, "nation").select(F.col("n_name").alias("name"))).df


@query("SELECT c_name AS name, CASE WHEN c_custkey = 3 THEN 23 WHEN c_custkey = 4 THEN 13 ELSE 10 END::BIGINT AS next, CASE WHEN c_custkey = 3 THEN 2 WHEN c_custkey = 4 THEN 1 ELSE 0 END::BIGINT AS gets FROM customer WHERE c_custkey <> 5")
def sequence_state(spark, d):
    """A table of named sequences, one of each customer: values are taken of two, one is opened again, and one is removed."""
    name, long = "Customer#%09d", lambda v: F.lit(v).cast("long")
    state = read(spark, d, "customer").select(F.col("c_name").alias("name"), long(10).alias("next"), long(0).alias("low"), long(1000).alias("high"), long(1).alias("step"), F.lit(False).alias("wrap"), long(0).alias("gets"))
    table = dml.Sequences(state).open(name % 3, 99).take(name % 3, 5)[0].take(name % 3, 8)[0].take(name % 4, 3)[0]
    return table.remove(name % 5).state.select("name", "next", "gets")


# Time to live


@query(f"""SELECT event_id, CASE WHEN e = 0 THEN 0 ELSE greatest(1, (e + 3599999) // 3600000 - ({1_705_000_000_000} + 3599999) // 3600000) END AS hours,
CASE WHEN event_id % 2 = 0 THEN n ELSE coalesce(e, n) END AS after FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE epoch_us(ts) // 1000 END AS e, epoch_us(ts) // 1000 + 5 AS n FROM events)""")
def ttl_absolute(spark, d):
    """Hours to an absolute expiration; and expirations after writes of which every second one updates them."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    e = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, 0).otherwise(ms).alias("e"), (ms + 5).alias("n"))
    after = F.when(F.col("event_id") % 2 == 0, ttl.updated(F.col("e"), F.col("n"), True)).otherwise(ttl.updated(F.col("e"), F.col("n"), False))
    return e.select("event_id", ttl.ttl_of(F.col("e"), F.lit(NOW)).alias("hours"), after.alias("after"))


def _rounded_ms(ts: str) -> Column:
    """The milliseconds of a time as epoch_ms has them: the nearest, of two as near the one farther from 1970."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))


def _expiring(spark, d, unit: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", "user_id", ttl.expiration(_rounded_ms("ts"), F.col("event_id") % 31, unit).alias("expires_ms"))


def _expiring_sql(ms: int) -> str:
    return f"SELECT event_id, user_id, CASE WHEN event_id % 31 = 0 THEN 0 ELSE ((epoch_ms(ts) + {ms} - 1) // {ms} + event_id % 31) * {ms} END AS expires_ms FROM events"




@query(f"SELECT * FROM ({_expiring_sql(86_400_000)}) WHERE expires_ms = 0 OR {NOW} < expires_ms")
def ttl_days(spark, d):
    return ttl.live(_expiring(spark, d, "DAYS"), NOW)


@query(f"SELECT * FROM ({_expiring_sql(3_600_000)}) WHERE expires_ms = 0 OR {NOW} < expires_ms")
def ttl_hours(spark, d):
    return ttl.live(_expiring(spark, d, "HOURS"), NOW)


@query(f"SELECT user_id AS usr, event_id FROM ({_expiring_sql(86_400_000)}) WHERE expires_ms = 0 OR {NOW} < expires_ms")
def ttl_secondary(spark, d):
    return index.view(Table(ttl.live(_expiring(spark, d, "DAYS"), NOW), ("event_id",)), Index("usr", "user_id"))


@query(f"SELECT event_id, CASE WHEN ((expires_ms + 3599999) // 3600000) % 24 <> 0 THEN 'HOURS' ELSE 'DAYS' END AS unit, expires_ms <> 0 AND {NOW + 7_200_000} >= expires_ms AS soon FROM ({_expiring_sql(3_600_000)})")
def ttl_units(spark, d):
    return _expiring(spark, d, "HOURS").select("event_id", ttl.unit_of(F.col("expires_ms")).alias("unit"), ttl.expires_within(F.col("expires_ms"), NOW).alias("soon"))


@query(f"SELECT expires_ms // 86400000 AS unit, count(*) AS n FROM ({_expiring_sql(86_400_000)}) GROUP BY 1")
def ttl_histogram(spark, d):
    return ttl.histogram(_expiring(spark, d, "DAYS"))


# Differences and checks


def _changed(spark, d) -> tuple[Table, Table]:
    t = orders(spark, d)
    t = t.of(t.df.select("o_orderkey", "o_orderstatus"))
    new = t.df.where("o_orderkey % 50 != 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 40 < 3, "N").otherwise(F.col("o_orderstatus")))
    return t.of(t.df.where("o_orderkey % 75 != 0")), t.of(new)


_DIFF = """WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 75 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 40 < 3 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 50 <> 0),
d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'only_right' WHEN b.o_orderkey IS NULL THEN 'only_left'
  WHEN a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus THEN 'same' ELSE 'different' END AS status FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey)"""


@query(f"{_DIFF} SELECT * FROM d WHERE status <> 'same'")
def diff_records(spark, d):
    return diff.records(*_changed(spark, d))


@query(f"""{_DIFF}, s AS (SELECT *, CASE WHEN status <> 'same' AND coalesce(lag(status) OVER (ORDER BY o_orderkey), 'same') = 'same' THEN 1 ELSE 0 END AS st FROM d),
r AS (SELECT *, sum(st) OVER (ORDER BY o_orderkey)::BIGINT AS region FROM s)
SELECT region, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n FROM r WHERE status <> 'same' GROUP BY region""")
def diff_regions(spark, d):
    return diff.regions(*_changed(spark, d))


@query("SELECT 'missing' AS \"check\", count(*) AS failures FROM orders WHERE o_orderkey % 90 = 0 UNION ALL SELECT 'orphan', count(*) FROM orders WHERE o_orderkey % 70 = 0 AND o_orderkey % 90 <> 0 UNION ALL SELECT 'foreign', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 <> 0)")
def verify_index(spark, d):
    t, c, i = orders(spark, d), customer(spark, d), Index("cust", "o_custkey", related="customer")
    stored = index.view(t, i).where("o_orderkey % 90 != 0").withColumn("cust", F.when(F.col("o_orderkey") % 70 == 0, -F.col("cust")).otherwise(F.col("cust")))
    whole = t.of(t.df.withColumn("o_custkey", F.col("o_custkey")))
    entries = stored.unionByName(index.view(whole, i).where("o_orderkey % 70 = 0 and o_orderkey % 90 != 0"))
    return diff.verify(t, i, entries, c.of(c.df.where("c_custkey % 11 != 0")))


@query(f"""WITH a AS (SELECT o_orderkey // 64 AS block, count(*) AS n FROM orders WHERE o_orderkey % 75 <> 0 GROUP BY 1), b AS (SELECT o_orderkey // 64 AS block, count(*) AS n FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY 1),
{_DIFF.removeprefix("WITH a AS").replace("(SELECT", "x AS (SELECT", 1).replace("b AS", "y AS", 1).replace("FROM a FULL OUTER JOIN b", "FROM x a FULL OUTER JOIN y b")}
SELECT coalesce(a.block, b.block) AS block, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, coalesce(a.block, b.block) NOT IN (SELECT o_orderkey // 64 FROM d WHERE status <> 'same') AS equal FROM a FULL OUTER JOIN b ON a.block = b.block""")
def diff_blocks(spark, d):
    return diff.blocks(*_changed(spark, d), 64)


@query(f"{_DIFF} SELECT * FROM d WHERE status <> 'same' ORDER BY o_orderkey LIMIT 100")
def diff_first(spark, d):
    """The first hundred differences: blocks that agree are left out before rows are compared."""
    return diff.block_records(*_changed(spark, d), 64, 100)


@query("SELECT count(*) AS out_of_order FROM (SELECT l_orderkey, lag(l_orderkey) OVER (ORDER BY n) AS b FROM (SELECT l_orderkey, row_number() OVER () AS n FROM lineitem)) WHERE b > l_orderkey")
def verify_order(spark, d):
    """Rows whose key is before that of the row stored before them."""
    return diff.disorder(diff.stored(read(spark, d, "lineitem"), "l_orderkey"), "l_orderkey")


@query("SELECT count(*) AS out_of_order FROM (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS b FROM events) WHERE b > user_id")
def verify_order_by(spark, d):
    return diff.disorder(read(spark, d, "events"), "user_id", ("event_id",))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def verify_repeats(spark, d):
    return diff.misplaced(read(spark, d, "lineitem"), "l_orderkey")


# Evolution and raw rows


@query("SELECT s_suppkey, s_name AS supplier_name FROM supplier")
def evolve_rename(spark, d):
    return evolve.evolve(read(spark, d, "supplier").select("s_suppkey", "s_name"), 0, {0: [evolve.Rename("s_name", "supplier_name")]})


@query("SELECT p_partkey, p_size::DOUBLE AS p_size, NULL::VARCHAR AS p_color FROM part")
def evolve_widen(spark, d):
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.DoubleType()), T.StructField("p_color", T.StringType())])
    return evolve.widen(read(spark, d, "part"), schema, ("p_partkey",))


@query("SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS p_retailprice FROM part")
def evolve_convert(spark, d):
    cents = evolve.Convert("p_retailprice", lambda c: F.round(c * 100).cast("long"))
    return evolve.evolve(read(spark, d, "part").select("p_partkey", "p_retailprice"), 0, {0: [cents]})


@query("SELECT s_suppkey, s_name FROM supplier")
def evolve_drop(spark, d):
    return evolve.evolve(read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), 0, {0: [evolve.Drop("s_acctbal")]})


@query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events")
def raw_object(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("props").alias("raw"))
    return evolve.raw_values(rows, {"k": "long"})


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def raw_roundtrip(spark, d):
    t = read(spark, d, "orders")
    return evolve.from_raw(evolve.raw(t), t.schema)


@query("SELECT s_suppkey, s_name || ' in ' || s_nationkey::VARCHAR AS label FROM supplier")
def evolve_row(spark, d):
    """A converter of whole rows, under which the key of an index falls."""
    to = lambda df: df.select("s_suppkey", F.concat("s_name", F.lit(" in "), F.col("s_nationkey").cast("string")).alias("label"))
    return evolve.evolve(read(spark, d, "supplier"), 0, {0: [evolve.ConvertRow(to, ("s_nationkey",))]})


def _versions(spark, d):
    p = read(spark, d, "part")
    old = p.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_size").alias("size"), "p_brand")
    new = p.where("p_partkey % 3 != 0").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_size", T.DoubleType())])
    return {0: old, 1: new}, {0: [evolve.RenameType("Part"), evolve.Rename("size", "p_size"), evolve.Drop("p_brand")]}, schema


@query("SELECT p_partkey, p_size::DOUBLE AS p_size FROM part")
def evolve_merged(spark, d):
    return evolve.merged(*_versions(spark, d))


@query("SELECT 0 AS version, count(*) AS n_read, count(*) AS n_converted FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 1, count(*), 0 FROM part WHERE p_partkey % 3 <> 0")
def evolve_eager(spark, d):
    """What a rewrite of all versions under the present schema read and changed."""
    return evolve.eager(*_versions(spark, d))[1]


# Text formats, statistics and encodings


@query("""SELECT line_no, line FROM (VALUES (0, 'VERSION=3'), (1, 'format=bytevalue'), (2, 'type=btree'), (3, 'dupsort=0'), (4, 'HEADER=END')) v(line_no, line)
UNION ALL SELECT 3 + 2 * rn, ' ' || lower(hex(encode(o_orderkey::VARCHAR))) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
UNION ALL SELECT 4 + 2 * rn, ' ' || lower(hex(encode(o_orderstatus || chr(9) || o_orderpriority))) FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
UNION ALL SELECT 5 + 2 * count(*), 'DATA=END' FROM orders""")
def dump_lines(spark, d):
    return dump.dump_lines(orders(spark, d), ["o_orderstatus", "o_orderpriority"])


@query("SELECT c_custkey::VARCHAR AS key, c_name || chr(9) || c_mktsegment AS data FROM customer")
def load_roundtrip(spark, d):
    return dump.load_lines(dump.dump_lines(customer(spark, d), ["c_name", "c_mktsegment"], "print"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name || chr(9) || chr(92) ELSE NULL END AS name FROM supplier")
def load_fields(spark, d):
    """Tabs, backslashes and nulls survive a dump."""
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("\t\\")))
    t = Table(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), name.alias("name")), ("id",))
    loaded = dump.load_lines(dump.dump_lines(t, ["name"], "print"))
    return loaded.select(F.col("key").cast("long").alias("id"), dump.fields_of(F.col("data"))[0].alias("name"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'loaded' END AS name FROM supplier")
def load_no_overwrite(spark, d):
    """A dump loaded into a table without overwriting: keys that are there keep their rows."""
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    t = Table(rows.where("id % 2 = 0"), ("id",))
    loaded = dump.load_lines(dump.dump_lines(t.of(rows.withColumn("name", F.lit("loaded"))), ["name"]))
    return dump.load_into(t, loaded.select(F.col("key").cast("long").alias("id"), F.col("data").alias("name")), overwrite=False).df


@query("SELECT s_suppkey::VARCHAR AS key, s_name AS data FROM supplier")
def load_plain(spark, d):
    """Plain lines, key and data in turn."""
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), F.posexplode(F.array(F.col("s_suppkey").cast("string"), "s_name")).alias("i", "line"))
    lines = cursor.numbered(rows, ["n", "i"], "line_no").select((F.col("line_no") - 1).alias("line_no"), "line")
    return dump.load_pairs(lines)


@query("SELECT event_id::VARCHAR AS event_id, value_a, value_b FROM (SELECT event_id, user_id::VARCHAR AS value_a, NULL AS value_b FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id::VARCHAR, event_type FROM events WHERE event_id % 2 <> 0)")
def stats_csv(spark, d):
    """CSV files of two headers, projected by name and by prefix."""
    folder = run_dir(spark, "stats")
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("value_a"), F.col("event_type").alias("value_b"))
    e.where("event_id % 2 = 0").select("value_a", "event_id").write.option("header", True).csv(f"{folder}/one")
    e.where("event_id % 2 != 0").write.option("header", True).csv(f"{folder}/two")
    return stats.read_stats(spark, [f"{folder}/one", f"{folder}/two"], ["event_id", "value_"])


@query("SELECT o_totalprice, o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def stats_project(spark, d):
    return stats.project(read(spark, d, "orders"), ["o_totalprice", "o_orderkey", "o_order"])


@query("SELECT user_id, event_id, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS value FROM events")
def stats_delta(spark, d):
    return stats.deltas(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", ["value"])


@query("SELECT o_orderkey, '80000000' || lpad(hex(o_orderkey), 8, '0') AS long_key, upper(hex(encode(o_orderstatus))) || '00' AS string_key FROM orders")
def sorted_keys(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.hex(codec.sorted_integer(F.col("o_orderkey"))).alias("long_key"), F.hex(codec.sorted_string(F.col("o_orderstatus"))).alias("string_key"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS place, CASE WHEN o_orderstatus = 'F' THEN '01' ELSE '00' END AS flag, CASE WHEN o_orderstatus = 'F' THEN '01' ELSE '00' END || hex(encode(o_orderpriority)) || '00' AS both FROM orders")
def sorted_kinds(spark, d):
    """Enumerations by their declaration, booleans, and keys of several parts."""
    flag = codec.sorted_boolean(F.col("o_orderstatus") == "F")
    return read(spark, d, "orders").select("o_orderkey", codec.enum_order(F.col("o_orderstatus"), ["P", "O", "F"]).cast("int").alias("place"), F.hex(flag).alias("flag"), F.hex(codec.composite(flag, codec.sorted_string(F.col("o_orderpriority")))).alias("both"))


# Change streams


def _events(spark, d) -> DataFrame:
    """The events as changes of transactions of ten; each seventh transaction aborts, and the last one stays open."""
    e = read(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 10).alias("txn"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("user_id").alias("key"), "value"
    )
    top = e.agg(F.max("txn").alias("top"))
    ends = e.select("txn").distinct().join(F.broadcast(top), F.col("txn") < F.col("top"))
    ends = ends.select((F.col("txn") * 10 + 10).alias("seq"), "txn", F.when(F.col("txn") % 7 == 0, "abort").otherwise("commit").alias("op"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"))
    return e.unionByName(ends)


_COMMITTED = "SELECT event_id AS seq, event_type, user_id AS key, value FROM events WHERE event_id // 10 < (SELECT max(event_id // 10) FROM events) AND (event_id // 10) % 7 <> 0"


_EARLY = "event_id <= (SELECT max(event_id) // 5 FROM events)"
_BASE_ROWS = f"SELECT user_id AS key, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events WHERE {_EARLY} GROUP BY 1"
_NET = f"SELECT * FROM ({_COMMITTED}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"


def _base(spark, d) -> DataFrame:
    """The last row of each user in the first fifth of the events."""
    e = read(spark, d, "events")
    top = e.agg(F.floor(F.max("event_id") / 5).alias("top"))
    e = e.join(F.broadcast(top), F.col("event_id") <= F.col("top"))
    return e.groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("seq"), F.max_by("value", "event_id").alias("value"))


@query(f"WITH net AS ({_NET}) SELECT key, seq, value FROM ({_BASE_ROWS}) WHERE key NOT IN (SELECT key FROM net WHERE key % 3 = 0) UNION ALL SELECT key, seq, value FROM net WHERE key % 3 = 0 AND event_type <> 'error'")
def cdc_apply(spark, d):
    """Changes of each third user, applied to a table that has rows of most."""
    changes = cdc.committed(_events(spark, d)).where("key % 3 = 0")
    return cdc.apply(_base(spark, d), changes)


@query("SELECT t AS txn, CASE WHEN t = (SELECT max(event_id // 10) FROM events) THEN 'open' WHEN t % 7 = 0 THEN 'abort' ELSE 'commit' END AS outcome, count(*) FILTER (event_type <> 'error') AS n_put, count(*) FILTER (event_type = 'error') AS n_delete FROM (SELECT *, event_id // 10 AS t FROM events) GROUP BY 1, 2")
def cdc_transactions(spark, d):
    return cdc.transactions(_events(spark, d))


@query("SELECT event_id AS seq, event_id // 10 AS txn, user_id AS key FROM events WHERE event_type = 'error' AND event_id BETWEEN 100 AND 900 AND user_id IN (1, 2, 3, 5, 8, 13)")
def log_print(spark, d):
    """A log's deletes of some keys within a range of sequence numbers."""
    return cdc.log_rows(_events(spark, d), ["delete"], [1, 2, 3, 5, 8, 13], None, 100, 900).select("seq", "txn", "key")


@query(f"SELECT key, seq, value FROM ({_COMMITTED}) WHERE event_type IN ('view', 'click')")
def cdc_filter(spark, d):
    """Committed changes of two of the tables that a log covers; the filter leaves the ends of transactions."""
    kinds = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("table"))
    events = _events(spark, d).join(kinds, "seq", "left")
    events = events.withColumn("table", F.when(F.col("op").isin("commit", "abort"), None).otherwise(F.col("table")))
    return cdc.committed(cdc.of_tables(events, ["view", "click"])).select("key", "seq", "value")


@query(f"SELECT key, seq, value FROM ({_COMMITTED}) WHERE seq >= 500")
def cdc_from_vlsn(spark, d):
    return cdc.from_sequence(cdc.committed(_events(spark, d)), 500).select("key", "seq", "value")


@query(f"SELECT key, CASE WHEN event_type <> 'error' THEN n.seq END AS new_seq, b.seq AS old_seq FROM ({_NET}) n LEFT JOIN ({_BASE_ROWS}) b USING (key)")
def cdc_triggers(spark, d):
    return cdc.triggers(_base(spark, d), cdc.committed(_events(spark, d))).select("key", F.col("new_data.seq").alias("new_seq"), F.col("old_data.seq").alias("old_seq"))


@query(f"SELECT key, seq, value FROM ({_COMMITTED}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND event_type <> 'error'")
def cdc_stream(spark, d):
    """The same by Structured Streaming: the events are written as files and replicated batch by batch."""
    folder = run_dir(spark, "cdc")
    events = _events(spark, d).repartitionByRange("seq").sortWithinPartitions("seq")
    events.write.parquet(f"{folder}/events")
    schema = "seq long, txn long, op string, key long, value double"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cdc.replicate(spark, f"{folder}/events", schema, folder, max(1, parts // 3)).awaitTermination()  # three or four batches
    return cdc.state(spark, folder).select("key", "seq", "value")
