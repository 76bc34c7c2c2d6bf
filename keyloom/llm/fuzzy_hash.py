"""Context-triggered piecewise hashing: signatures whose chunks end where a rolling hash says, compared by edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, free, map_arrow, mix64, text_buffers, written
from .shingles import powers

WINDOW, CHUNKS, LEAST_BLOCK = 7, 48, 3
#: The block is halved while a signature has fewer digits than the first, unless it would have more than the last then.
DIGITS_LEAST, DIGITS_MOST = CHUNKS // 2, 64
DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_U = np.uint64


def block_size(n: int) -> int:
    """The power-of-two multiple of LEAST_BLOCK at which n bytes have at most about CHUNKS chunks."""
    size = LEAST_BLOCK
    while size * CHUNKS < n:
        size *= 2
    return size


def chunk_ends(rolling: np.ndarray, block: int) -> np.ndarray:
    """Where the chunks end: after each byte at which the rolling hash is -1 modulo block, after each 2 * block bytes without one, and at the end."""
    n = len(rolling)
    ends = np.flatnonzero(rolling % _U(block) == _U(block - 1)) + 1
    ends = np.append(ends[ends < n], n)
    begins = np.append(0, ends[:-1])
    pieces = (ends - begins - 1) // (2 * block) + 1
    at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.minimum(np.repeat(begins, pieces) + (at + 1) * 2 * block, np.repeat(ends, pieces))


def fingerprint(data: np.ndarray) -> str:
    """`block:signature:signature at twice the block` of some bytes; equal bytes have equal fingerprints.

    A chunk ends at each byte whose WINDOW bytes hash to -1 modulo the block size, after two blocks without such
    a byte, and at the end; its digit is six bits of the hash of its bytes. The block size follows from the length and is
    then halved if there are few digits; no chunk is left out. Empty input gives `3::`.
    """
    n = len(data)
    size = block_size(n)
    if not n:
        return f"{size}::"
    up, down = powers(max(22, int(n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[:n], out=sums[1:])
    first = np.maximum(np.arange(1, n + 1) - WINDOW, 0)
    rolling = mix64((sums[1:] - sums[first]) * down[first]) >> _U(20)
    while size > LEAST_BLOCK and len(chunk_ends(rolling, size)) < DIGITS_LEAST and len(chunk_ends(rolling, size // 2)) <= DIGITS_MOST:
        size //= 2
    parts = []
    for block in (size, 2 * size):
        ends = chunk_ends(rolling, block)
        begins = np.append(0, ends[:-1])
        hashed = mix64((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype(np.uint64))
        parts.append(DIGITS[(hashed >> _U(58)).astype(np.int64)].tobytes().decode())
    return f"{size}:{parts[0]}:{parts[1]}"


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Edit distances of many pairs of short strings, one step of the table for all pairs at a time."""
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    k = 0
    while k < len(order):
        many = max(1, min(512, (1 << 22) // (1 + max(len(x) for i in order[k : k + 512] for x in pairs[i]))))
        some, k = order[k : k + many], k + many
        la, lb = (np.array([len(pairs[i][x]) for i in some]) for x in (0, 1))
        a, b = (np.zeros((len(some), max(1, int(m.max()))), np.uint8) for m in (la, lb))
        for row, i in enumerate(some):
            a[row, : la[row]] = np.frombuffer(pairs[i][0].encode(), np.uint8)
            b[row, : lb[row]] = np.frombuffer(pairs[i][1].encode(), np.uint8)
        width = b.shape[1]
        steps = np.arange(width + 1, dtype=np.int16 if width + a.shape[1] < 1 << 15 else np.int32)
        line = np.broadcast_to(steps, (len(some), width + 1)).copy()
        final = np.where(la == 0, lb, 0)
        for r in range(1, a.shape[1] + 1):
            fresh = np.empty_like(line)
            fresh[:, 0] = r
            fresh[:, 1:] = np.minimum(line[:, 1:] + 1, line[:, :-1] + (b != a[:, r - 1 : r]))
            # insertions: the least of fresh[j'] + (j - j') over j' <= j
            line = np.minimum.accumulate(fresh - steps, axis=1) + steps
            ended = np.flatnonzero(la == r)
            final[ended] = line[ended, lb[ended]]
        out[some] = final
    return out


def likenesses(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 less the edit distance over the longer signature, at the best block
    size that both have; 0 if they have none in common; 1 for equal fingerprints."""
    out = np.zeros(len(pairs))
    todo: list[tuple[str, str]] = []
    owner = []
    for i, (x, y) in enumerate(pairs):
        if x == y:
            out[i] = 1.0
            continue
        (bx, sx, dx), (by, sy, dy) = x.split(":"), y.split(":")
        one, two = {int(bx): sx, 2 * int(bx): dx}, {int(by): sy, 2 * int(by): dy}
        for block in one.keys() & two.keys():
            if one[block] and two[block]:
                todo.append((one[block], two[block]))
                owner.append(i)
    if todo:
        longest = np.array([max(len(a), len(b)) for a, b in todo])
        np.maximum.at(out, owner, 1 - edit_distances(todo) / longest)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", into: str = "fingerprint", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and the fingerprint of each whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column(0))
            made = [fingerprint(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, pa.string())], names=[*keep, into])

    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField(into, T.StringType())])
    return map_arrow(docs.select(docs[text_col].alias(free("_text", docs)), *(docs[k] for k in keep)), run, schema)


#: Rows of a range at most, on average; there are as many ranges as shuffle partitions, or more.
RANGE_ROWS = 100_000


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text in ranges of descending ids, sorted within: each text travels once.

    Ties go by a hash of the text, then the text, so that many rows of one id or of none are cut into ranges as well;
    rows equal in both are told apart by where they lie, which changes no result.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // RANGE_ROWS))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    order = F.col("id").desc_nulls_last(), F.col("tie").asc()
    return rows.repartitionByRange(parts, *order, F.col("place").asc()).sortWithinPartitions(*order, "text").select("id", "text")


#: What compare() makes of each row.
FACTS = {"n_chars": T.LongType(), "edited_sha256": T.StringType(), "fingerprint": T.StringType(), "edited_fingerprint": T.StringType(), "near_edited": T.DoubleType(), "near_next": T.DoubleType()}


def printed(text: str) -> str:
    return fingerprint(np.frombuffer(text.encode(), np.uint8))


def compare(texts: list[str], prints: list[str]) -> list[list]:
    """The columns FACTS of all texts but the last, each edited by the one after it; prints: the texts' fingerprints."""
    n_chars, digests, edited = [], [], []
    for text, after in zip(texts, texts[1:]):
        cut = len(text) // 3
        changed = text[: len(text) - cut] + after[:cut]
        n_chars.append(len(text))
        digests.append(hashlib.sha256(changed.encode()).hexdigest())
        edited.append(printed(changed))
    near = likenesses([*zip(prints, edited), *zip(prints, prints[1:])])
    return [n_chars, digests, prints[: len(edited)], edited, near[: len(edited)], near[len(edited) :]]


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its id (of any type that sorts), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has the last third of the code points replaced by as many of the start of the next text by
    descending id (all of it, if that is shorter); the last row's next is the first, and a single row's is itself.
    Null counts as empty; rows repeated with one id follow one another by a hash of the text, and rows without id come
    last. Texts of any length are read whole. An empty table gives an empty result; other columns, whatever their
    names, play no part.

    A task reads its range in order and holds some megabytes of it. The first and the last row of each range are
    written beside the results, and meet in a second, small job.
    """
    kind = docs.schema[id_col].dataType
    made = [T.StructField(n, k) for n, k in FACTS.items()]
    edge = [T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType())]
    schema = T.StructType([T.StructField("id", kind), *made, *edge])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def rows(ids: pa.Array, facts: list[list] | None, part: int | None = None, name: str | None = None, text: str | None = None) -> pa.RecordBatch:
        facts = facts or [[None] for _ in FACTS]
        columns = [ids, *facts, *([x] * len(ids) for x in (part, name, text))]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, texts, prints = pa.array([], types[0]), [], []  # the row that waits for the one after it
        for batch in batches:
            _, at = text_buffers(batch.column(1))
            for i, j in chunks(at):
                some = batch.column(1).slice(i, j - i).to_pylist()
                if not texts and j > i:
                    yield rows(batch.column(0).slice(i, 1), None, part, "first", some[0])
                texts, prints = texts + some, prints + [printed(t) for t in some]
                ids = pa.concat_arrays([ids, batch.column(0).slice(i, j - i)])
                if len(texts) > 1:
                    yield rows(ids.slice(0, len(ids) - 1), compare(texts, prints))
                    ids, texts, prints = ids.slice(len(ids) - 1), texts[-1:], prints[-1:]
        if texts:
            yield rows(ids, None, part, "last", texts[0])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                texts = [batch.column(1)[k].as_py(), batch.column(2)[k].as_py()]
                yield rows(batch.column(0).slice(k, 1), compare(texts, [printed(t) for t in texts]))

    found = written(map_arrow(in_order(docs, id_col, text_col), run, schema), "compared")
    lasts = found.where("edge = 'last'").select("id", "part", F.col("text").alias("own"))
    firsts = found.where("edge = 'first'").select(F.col("part").alias("after"), "text")
    parts = firsts.select(F.col("after").alias("p"))
    top = F.first("p").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select("p", F.coalesce(F.lead("p").over(Window.orderBy("p")), top).alias("after"))  # two numbers per range
    pairs = lasts.join(parts, F.col("part") == F.col("p")).join(firsts, "after").select("id", "own", "text")
    out = found.where("edge is null").unionByName(map_arrow(pairs, join, schema))
    return out.select(F.col("id").alias(id_col), *FACTS)
