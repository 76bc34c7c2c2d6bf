"""Exact deduplication by 128-bit content hash, with the bytes compared inside each group."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, lookup, written

#: Bits of the map of hashes that occur more than once: so many for each such hash, and at most so many (32 MB).
BITS_PER_HASH, MOST_BITS = 16, 1 << 28
#: Bits of one row of the map.
ROW_BITS = 1 << 15


@dataclass(frozen=True)
class Groups:
    """thin: id, h, s (128- and 256-bit hashes of the text) of each row. labels: h, s, keep_id, n, n_keep of each group of rows
    with equal bytes, two rows at least. bits: a map of the labels' hashes, to leave out other rows where they lie."""

    thin: DataFrame
    total: int
    labels: DataFrame
    bits: DataFrame
    n_bits: int


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def _marked(rows: DataFrame, h: str, g: Groups | tuple[DataFrame, int], into: str) -> DataFrame:
    """rows with a boolean: false for every row whose hash h occurs once, but for a few in a hundred."""
    bits, n_bits = (g.bits, g.n_bits) if isinstance(g, Groups) else g
    place = F.pmod(F.xxhash64(h), F.lit(n_bits).cast("long"))
    row, held = free("_row", rows), free("_bits", rows)
    side = bits.select(F.col("bucket").alias(row), F.col("bits").alias(held))
    out = rows.join(F.broadcast(side), F.bitmap_bucket_number(place) == F.col(row), "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return out.withColumn(into, F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) > 0, F.lit(False))).drop(row, held)


def groups_of(docs: DataFrame, id_col: str, text_col: str, keep: str) -> Groups:
    """One pass writes hashes; a second one brings together the bytes of rows whose hash occurs more than once, and of no others.

    Texts are combined where they lie, so that of a group of many copies one text per task travels. Texts that share
    both hashes but differ in their bytes would raise an error.
    """
    thin = docs.select(F.col(f"`{id_col}`").alias("id"), _text(text_col).alias("t")).select("id", F.md5("t").alias("h"), F.sha2("t", 256).alias("s"))
    thin = written(thin, "hashes")
    rows = thin.groupBy("h", "s", "id").agg(F.count("*").alias("c"))
    best, by = (F.min, F.min_by) if keep == "smallest" else (F.max, F.max_by)
    groups = rows.groupBy("h", "s").agg(best("id").alias("keep_id"), F.sum("c").alias("n"), F.coalesce(by("c", "id"), F.sum("c")).alias("n_keep"))
    groups = written(groups.where("n > 1"), "groups")
    n_groups = groups.count()
    n_bits = ROW_BITS
    while n_bits < min(MOST_BITS, BITS_PER_HASH * n_groups):
        n_bits *= 2
    place = F.pmod(F.xxhash64("h"), F.lit(n_bits).cast("long"))
    bits = groups.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("i"))
    bits = written(bits.groupBy("bucket").agg(F.bitmap_construct_agg("i").alias("bits")), "bits")
    texts = docs.select(_text(text_col).alias("t")).withColumn("h", F.md5("t"))
    texts = _marked(texts, "h", (bits, n_bits), "many").where("many").groupBy("h", "t").agg(F.count("*").alias("n_bytes"))
    proven = texts.select("h", F.sha2("t", 256).alias("s"), "n_bytes").groupBy("h", "s").agg(F.count("*").alias("m"), F.sum("n_bytes").alias("n_bytes"))
    labels = groups.join(proven, ["h", "s"])
    whole = (F.col("m") == 1) & (F.col("n_bytes") == F.col("n"))
    keep_id = F.when(whole, F.col("n")).otherwise(F.raise_error(F.lit("different texts share an MD5 and a SHA-256")).cast("long"))
    labels = labels.select("h", "s", "keep_id", keep_id.alias("n"), "n_keep")
    return Groups(thin, thin.count(), written(labels, "labels"), bits, n_bits)


def exact_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """For each row of docs: its id, keep_id, group_size, kept and text_sha256, from the table of hashes: texts are read twice, and those that occur once never travel.

    A group is the rows with the same bytes of text, of any length; null text counts as empty. The row with the smallest
    (or largest) id stays; rows without id go after all others. Rows repeated with the id that stays are all kept. An
    empty table gives an empty result; other columns of docs, whatever their names, play no part.
    """
    g = groups_of(docs, id_col, text_col, keep)
    rows = lookup(g.thin, g.labels, ["h", "s"], "n", g.total, F.col("id"), "label")
    keep_id = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("label.keep_id"))
    out = rows.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("label.n", F.lit(1)).cast("long").alias("group_size"), F.col("s").alias("text_sha256"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))).select(id_col, "keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of docs for each text, with docs' columns, whatever their names; of rows repeated with the same id, one stays.

    Rows whose hash occurs once pass where they lie. Null text counts as empty; rows without id go after all others; an
    empty table stays empty; texts of any length are compared whole.
    """
    g = groups_of(docs, id_col, text_col, keep)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    h, s, many, label = (free(n, docs) for n in ("_h", "_s", "_many", "_label"))
    rows = _marked(docs.withColumn(h, F.md5(_text(text_col))), h, g, many)
    once = rows.where(~F.col(many)).select(*columns)
    again = rows.where(F.col(many)).drop(many).withColumn(s, F.sha2(_text(text_col), 256))
    sides = g.labels.select(F.col("h").alias(h), F.col("s").alias(s), "keep_id", "n", "n_keep")
    again = lookup(again, sides, [h, s], "n", g.total, F.col(f"`{id_col}`"), label)
    again = again.where(F.col(label).isNull() | F.col(f"`{id_col}`").eqNullSafe(F.col(f"{label}.keep_id")))
    several = F.coalesce(F.col(f"{label}.n_keep"), F.lit(1)) > 1
    rest = F.to_json(F.struct(*columns))
    one = again.where(several).groupBy(h, s).agg(F.min_by(F.struct(*columns), rest).alias(label)).select(f"{label}.*")
    return once.unionByName(again.where(~several).select(*columns)).unionByName(one)
