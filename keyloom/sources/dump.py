"""The dump text format: a header, then lines of key and data in turn, then an end mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Table
from ..operators.dml import put
from ..operators.ordered import numbered

#: The lines of the format.
VERSION, KIND, END = "VERSION=3", "type=btree", "DATA=END"
HEADER_END = "HEADER=END"
#: Lines of a header at most.
HEADER_LINES = 100


#: The header's names, each before an equals sign.
NAMES = ("VERSION", "format", "type", "dupsort")


class FormatError(ValueError):
    """The text is no whole dump."""


def encoded(c: Column, form: str) -> Column:
    """bytevalue: hexadecimal. print: printable ASCII as it is, a backslash doubled, other bytes as backslash and two digits."""
    digits = F.lower(F.hex(c.cast("binary")))
    if form == "bytevalue":
        return digits
    pairs = F.regexp_extract_all(digits, F.lit("(..)"), 1)

    def one(p: Column) -> Column:
        code = F.conv(p, 16, 10).cast("int")
        return F.when(p == "5c", F.lit("\\\\")).when((code >= 32) & (code <= 126), F.chr(code)).otherwise(F.concat(F.lit("\\"), p))

    return F.concat_ws("", F.transform(pairs, one))


def decoded(c: Column, form: str) -> Column:
    """The bytes of an encoded field."""
    if form == "bytevalue":
        return F.unhex(c)
    parts = F.regexp_extract_all(c, F.lit(r"(\\\\|\\[0-9a-f]{2}|[^\\])"), 1)

    def one(p: Column) -> Column:
        return F.when(p == "\\\\", F.lit("5c")).when(F.length(p) == 3, F.substring(p, 2, 2)).otherwise(F.lower(F.hex(p.cast("binary"))))

    return F.unhex(F.concat_ws("", F.transform(parts, one)))


def field(c: Column) -> Column:
    """A value as text in a record of tab-separated fields: backslash, tab and line end escaped, null as a backslash and N."""
    text = F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    return F.coalesce(text, F.lit("\\N"))


def fields_of(c: Column) -> Column:
    """The fields of such a record, as an array of strings with nulls where they were."""

    def one(x: Column) -> Column:
        held = F.replace(x, F.lit("\\\\"), F.lit("\0"))
        return F.when(x != "\\N", F.replace(F.replace(F.replace(held, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\")))

    return F.transform(F.split(c, "\t", -1), one)


def dump_lines(table: Table, data: list[str], form: str = "bytevalue") -> DataFrame:
    """(line_no, line): the whole dump, in key order; key and data are their columns' values as fields, joined by tabs."""
    rows = numbered(table.df, list(table.order), "_n")
    fields = [F.concat_ws("\t", *(field(F.col(c)) for c in cols)) for cols in (table.key, data)]
    pairs = rows.select("_n", F.posexplode(F.array(*(encoded(f, form) for f in fields))).alias("_i", "line"))
    head = [VERSION, f"format={form}", KIND, f"dupsort={int(table.duplicates)}", HEADER_END]
    body = pairs.select((F.col("_n") * 2 + F.col("_i") + len(head) - 2).alias("line_no"), F.concat(F.lit(" "), "line").alias("line"))
    spark = table.df.sparkSession
    top = spark.createDataFrame(list(enumerate(head)), "line_no long, line string")
    end = rows.agg((F.count("*") * 2 + len(head)).alias("line_no")).withColumn("line", F.lit(END))
    return top.unionByName(body).unionByName(end)


def load_lines(lines: DataFrame, form: str | None = None, ignore_unknown: bool = False) -> DataFrame:
    """(key, data) as strings from (line_no, line); an odd number of data lines or no end mark raises FormatError.

    So does a header line of an unknown name, unless ignore_unknown is set.
    """
    head = lines.where((F.col("line") == HEADER_END) | (F.col("line") == END)).groupBy("line").agg(F.min("line_no").alias("n")).collect()
    ends = {r["line"]: r["n"] for r in head}
    if END not in ends or HEADER_END not in ends:
        raise FormatError("the dump has no end")
    marks = lines.where(F.col("line_no") <= ends[HEADER_END]).orderBy("line_no").limit(HEADER_LINES + 1).collect()
    if len(marks) > HEADER_LINES:
        raise FormatError("the header is too long")
    texts = {r["line"]: r["line_no"] for r in marks} | {END: ends[END]}
    if unknown := [t for t in texts if t not in (HEADER_END, END) and t.split("=")[0] not in NAMES]:
        if not ignore_unknown:
            raise FormatError(f"unknown header line {unknown[0]}")
    form = form or next(t.removeprefix("format=") for t in texts if t.startswith("format="))
    first = texts[HEADER_END] + 1
    if (texts[END] - first) % 2:
        raise FormatError("a key has no data")
    body = lines.where((F.col("line_no") >= first) & (F.col("line_no") < texts[END]))
    return _pairs(body, first, F.decode(decoded(F.substring("line", 2, 1 << 30), form), "utf-8"))


def _pairs(body: DataFrame, first: int, value: Column) -> DataFrame:
    body = body.select(F.floor((F.col("line_no") - first) / 2).alias("_n"), F.pmod(F.col("line_no") - first, F.lit(2)).alias("_i"), value.alias("v"))
    return body.groupBy("_n").agg(F.max(F.when(F.col("_i") == 0, F.col("v"))).alias("key"), F.max(F.when(F.col("_i") == 1, F.col("v"))).alias("data")).drop("_n")


def load_pairs(lines: DataFrame) -> DataFrame:
    """(key, data) from plain lines of text (line_no from 0, line), key and data in turn, without a header; an odd number raises FormatError."""
    if lines.count() % 2:
        raise FormatError("a key has no data")
    escaped = F.when(F.col("line").contains("\\"), F.decode(decoded(F.col("line"), "print"), "utf-8")).otherwise(F.col("line"))
    return _pairs(lines, 0, escaped)


def load_into(table: Table, rows: DataFrame, overwrite: bool = True) -> Table:
    """A table after loading rows of its columns: those of keys that are there replace the old ones, or are left out."""
    return put(table, rows, "OVERWRITE" if overwrite else "NO_OVERWRITE")


def write_dump(table: Table, data: list[str], path: str, form: str = "bytevalue") -> None:
    """The dump as text files whose names are in line order."""
    lines = dump_lines(table, data, form)
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.text(path)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(key, data) from a dump written by write_dump: files by name, lines by their place in the file."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return load_lines(numbered(rows, ["_file", "_block", "_id"], "line_no").select("line_no", "line"))
