"""Near-duplicate groups: min-max hashing proposes links, full shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free, hot_limit, lookup, map_arrow, mix64, text_buffers, written
from .components import components
from .shingles import shingle_sets

PERMUTATIONS, BAND = 100, 5
#: Rows of a bucket for each place at which its pairs are compared, and places at most.
BLOCK, MOST_PLACES = 1000, 64


def signatures(values: np.ndarray, begins: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """A row per set (none empty) of 2 x permutations numbers: the least and the greatest under each permutation.

    Neighbouring columns come from different permutations, so that a band holds no least and greatest of one.
    """
    rng = np.random.default_rng(7)
    a, b = rng.integers(1 << 31, 1 << 32, (2, permutations), dtype=np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    starts = begins[:-1]
    out = np.empty((len(starts), 2 * permutations), np.uint32)
    for i in range(permutations):
        v = x * (a[i] | np.uint32(1)) + b[i]
        out[:, 2 * i] = np.minimum.reduceat(v, starts)
        out[:, (2 * (i + permutations // 3) + 1) % (2 * permutations)] = np.maximum.reduceat(v, starts)
    return out


def band_keys(sig: np.ndarray, band: int = BAND) -> np.ndarray:
    n = sig.shape[1] // band
    parts = sig[:, : n * band].reshape(len(sig), n, band).astype(np.uint64)
    keys = np.broadcast_to(np.arange(n, dtype=np.uint64), parts.shape[:2])
    for j in range(band):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys


def fingerprints(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Two 64-bit sums for each set; equal sets have equal ones."""
    out = np.zeros((2, len(begins) - 1), np.uint64)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            out[i, full] = np.add.reduceat(mix64(values ^ np.uint64(salt)), begins[full])
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_buffers(batch.column(1))
        for i, j in chunks(at):
            values, begins = shingle_sets(data, at[i : j + 1])
            f = fingerprints(values, begins)
            full = np.flatnonzero(np.diff(begins))
            keys = band_keys(signatures(values, np.append(begins[full], len(values)))) if len(full) else np.zeros((0, 1), np.uint64)
            sizes = np.zeros(j - i, np.int32)
            sizes[full] = keys.shape[1]
            bands = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes, dtype=np.int32)).astype(np.int32), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(begins)), pa.array(f[0]), pa.array(f[1]), bands], names=["id", "n_shingles", "f1", "f2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of the texts whose fingerprints are those given: another row of the same id may have another text."""
    for batch in batches:
        data, at = text_buffers(batch.column(1))
        f1, f2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for i, j in chunks(at):
            values, begins = shingle_sets(data, at[i : j + 1])
            f = fingerprints(values, begins)
            sets = pa.ListArray.from_arrays(begins.astype(np.int32), pa.array(values.view(np.int64)))
            same = pa.array((f[0] == f1[i:j]) & (f[1] == f2[i:j]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), sets], names=["node", "shingles"]).filter(same)


def _id_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def _likeness(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their set sizes na, nb and the size of the intersection. The pairs of one b, of which a center may have
    very many, are dealt to as many places as they need, each with a copy of its set."""
    pairs = written(pairs, "pairs")
    limit = hot_limit(pairs.count())
    hot = written(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("b", F.ceil(F.col("n") / max(1, limit)).alias("places")), "hot")
    places = F.coalesce("places", F.lit(1)).cast("long")
    left = pairs.join(F.broadcast(hot), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), places).alias("place"))
    right = sets.withColumnRenamed("node", "b").join(F.broadcast(hot), "b", "left")
    right = right.select("b", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("place"), F.col("shingles").alias("sb"))
    both = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(right, ["b", "place"])
    return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))


def _linked(percent: int) -> Column:
    return (100 + percent) * F.col("shared") >= percent * (F.col("na") + F.col("nb"))


def _rest(members: DataFrame, labels: DataFrame, stars: DataFrame, sets: DataFrame, total: int, percent: int) -> DataFrame:
    """The pairs (a, b) of one bucket, not yet in one component, that can be alike enough; each once.

    A pair (x, y) shares at most min(|x & c|, |y & c|) shingles of the bucket's center c, and outside c at most the
    lesser of what each holds of shingles that occur twice among these nodes. Pairs whose bound is too low fall.
    """
    rows = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    rows = written(lookup(rows, split.select("key", "m"), ["key"], "m", total, F.col("node"), "_b").where("_b is not null").withColumn("m", F.col("_b.m")).drop("_b"), "open")
    nodes = rows.groupBy("node").agg(F.collect_set("key").alias("keys"))
    held = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("s"))
    alone = held.groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    nodes = nodes.join(alone, "node", "left").select("node", "keys", F.coalesce("alone", F.lit(0)).alias("alone"))
    rows = rows.join(nodes, "node").withColumn("useful", F.col("n") - F.col("alone")).where(100 * F.col("useful") >= percent * F.col("n"))
    near = stars.select(F.col("a").alias("node"), F.col("b").alias("center"), "shared")
    rows = rows.join(near, ["node", "center"], "left")
    rows = rows.withColumn("inside", F.when(F.col("node") == F.col("center"), F.col("n")).otherwise(F.col("shared"))).drop("shared")
    # a large bucket's rows are dealt to places, each of which has all its rows on the other side
    places = F.least(F.lit(MOST_PLACES), F.ceil(F.col("m") / BLOCK)).cast("long").alias("places")
    rows = written(rows.select("key", "node", "label", "n", "keys", "inside", (F.col("useful") - F.col("inside")).alias("outside"), places), "open")
    bound = F.least("x.inside", "y.inside") + F.greatest(F.lit(0), F.least("x.outside", "y.outside"))
    fits = (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & ((100 + percent) * bound >= percent * (F.col("x.n") + F.col("y.n")))
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    x = rows.withColumn("place", F.pmod(F.xxhash64("node"), F.col("places")))
    y = rows.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)))
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.place") == F.col("y.place"))
    return x.alias("x").join(y.alias("y"), same & fits & once).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """For each row of docs: its id, n_shingles, component_id (the least id reachable over links) and kept.

    Rows are linked whose sets of five-word shingles have 100 * intersection >= percent * union. Equal sets form a
    class, whose least id is its node. Nodes that agree in one of 40 bands of min-max hashes share a bucket; a
    pair at 75 % is in no common bucket with probability 2e-5. First each node of a bucket is compared with the
    bucket's least node; then, in buckets whose nodes are not yet in one component, all pairs of different
    components are, but for those that a bound excludes. Each comparison is of full sets.

    Null and empty texts and texts of white space have no shingles and link with nothing. Rows without id link
    with nothing, have component_id null and are kept. Rows repeated with one id share one node and one decision. Of
    texts of any length all shingles count; an empty table gives an empty result; other columns of docs, whatever their
    names, play no part.
    """
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("n_shingles", "f1", "f2")]
    signed = written(map_arrow(texts, _signed, T.StructType([T.StructField("id", kind), *longs, T.StructField("bands", T.ArrayType(T.LongType()))])), "signed")
    classes = signed.where("n_shingles > 0 and id is not null").groupBy("f1", "f2").agg(
        F.min("id").alias("node"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = written(classes, "classes")
    total = classes.count() * 2 * PERMUTATIONS // BAND
    buckets = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("center")).where("m > 1")
    members = lookup(buckets, shared, ["key"], "m", total, F.col("node"), "_b").where("_b is not null")
    members = written(members.select("key", "node", "n", F.col("_b.center").alias("center")), "members")

    need = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "f1", "f2")
    sets = texts.join(need, texts["id"] == need["node"]).select("id", "text", "f1", "f2")
    sets = written(map_arrow(sets, _sets, T.StructType([T.StructField("node", kind), T.StructField("shingles", T.ArrayType(T.LongType()))])), "sets")
    pairs = members.where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    stars = written(_likeness(pairs, sets), "stars")
    links = stars.where(_linked(percent)).select("a", "b")
    labels = written(components(links), "labels")
    more = _likeness(_rest(members, labels, stars, sets, total, percent), sets).where(_linked(percent)).select("a", "b")
    more = written(more, "more")
    if not more.isEmpty():
        tree = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = written(components(tree.unionByName(more)), "labels")

    named = classes.select("f1", "f2", "node", "copies").join(labels, "node", "left")
    named = named.select("f1", "f2", "copies", F.coalesce("label", "node").alias("component"))
    rows = signed.select("id", "n_shingles", "f1", "f2")
    out = lookup(rows, named, ["f1", "f2"], "copies", signed.count(), F.col("id"), "_c")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("_c.component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """docs without the rows that are not the least of their group; all columns as they are, whatever their names.

    Rows of null and empty texts and rows without id stay, and all rows repeated with an id that is kept; an empty
    table stays empty.
    """
    name = free("_gone", docs)
    gone = written(near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col(id_col).alias(name)).distinct(), "gone")
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
