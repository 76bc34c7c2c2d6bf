"""A weak-label quality classifier: expectation-maximisation weighs heuristic labellers, their posterior trains a hashed linear scorer."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_arrow, mix64, text_buffers, written
from .shingles import powers

#: Labellers, in the order of their votes: 1 good, -1 bad, 0 neither.
LABELLERS = ("symbols", "letters", "shouting", "repeats", "variety", "sentences", "lengths", "lines", "glyphs")
#: Rows of the scorer's training sample at most, and code points of all its texts together.
TRAIN_ROWS, TRAIN_POINTS = 8000, 20_000_000
HASHED = 1 << 14
EM_ROUNDS, EPOCHS, RATE = 40, 200, 0.05

#: Code points of a word that count for its shape.
SHAPED = 40


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    """For each code point, what kind of character it is, and the character that stands for it in word shapes."""
    points = [chr(c) for c in range(0x110000)]
    out = {name: np.fromiter(map(f, points), bool, len(points)) for name, f in (("alpha", str.isalpha), ("alnum", str.isalnum), ("upper", str.isupper), ("lower", str.islower), ("digit", str.isdigit), ("white", str.isspace))}
    shape = np.arange(len(points), dtype=np.uint32)
    shape[out["alpha"]] = ord("x")
    shape[out["upper"]] = ord("A")
    shape[out["lower"]] = ord("a")
    shape[out["digit"]] = ord("0")
    out["shape"] = shape
    for name, some in (("blank", " \t\n\v\f\r"), ("end", ".!?…"), ("close", "\"')]")):
        out[name] = np.zeros(len(points), bool)
        out[name][[ord(c) for c in some]] = True
    return out


@dataclass
class Facts:
    """Facts of several texts, a value each, and how often each hashed word shape occurs in each."""

    values: dict[str, np.ndarray]
    slots: np.ndarray
    counts: np.ndarray
    begin: np.ndarray  # of each text's slots (len + 1)


def facts_of(texts: list[str]) -> Facts:
    """All at once on arrays of code points."""
    t = _tables()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    at = np.cumsum([0, *(len(x) + 1 for x in texts)])
    starts, ends = _runs(~t["blank"][points])
    first = np.searchsorted(starts, at)
    n = np.diff(first)
    some = np.maximum(n, 1)

    def per_word(kind: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(kind))
        return sums[ends] - sums[starts]

    def per_text(word: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(word))
        return sums[first[1:]] - sums[first[:-1]]

    names, letters = per_word(t["alnum"][points]), per_text(per_word(t["alpha"][points]))
    last = ends - 1
    while len(more := np.flatnonzero(t["close"][points[last]] & (last > starts))):
        last[more] -= 1
    low = np.frombuffer("\n".join(x.lower() for x in texts).encode("utf-32-le"), np.uint32)
    low_starts, low_ends = _runs(~t["blank"][low])
    word = _hashes(low)(low_starts, low_ends)
    owner = np.repeat(np.arange(len(texts)), n)
    again = np.append(False, (word[1:] == word[:-1]) & (owner[1:] == owner[:-1]))[: len(word)]
    order = np.lexsort((word, owner))
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    lines = [[y for y in x.splitlines() if y.strip()] for x in texts]

    inside = np.zeros(len(points), bool)
    place = np.arange(len(points)) - np.repeat(np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(points)]))))
    kinds = t["shape"][points]
    inside[:] = ~t["blank"][points] & (place < SHAPED)
    inside[1:] &= (kinds[1:] != kinds[:-1]) | (place[1:] == 0)
    kept = np.append(0, np.cumsum(inside))
    slot = (_hashes(kinds[inside])(kept[starts], kept[ends]) % np.uint64(HASHED)).astype(np.int64)
    pair, count = np.unique(owner * HASHED + slot, return_counts=True)
    values = {
        "n": n,
        "marks": per_text(ends - starts - names >= 2) / some,
        "letters": letters / np.maximum(1, per_text(per_word(~t["white"][points]))),
        "upper": per_text(per_word(t["upper"][points])) / np.maximum(1, letters),
        "again": per_text(again) / np.maximum(1, n - 1),
        "distinct": np.bincount(owner[order][fresh], minlength=len(texts)) / some,
        "glyphs": per_text(names == 0) / some,
        "ends": per_text(t["end"][points[last]]) / some,
        "mean": letters / some,
        "lines": np.array([len(set(x)) / max(1, len(x)) for x in lines]),
    }
    return Facts(values, pair % HASHED, count, np.searchsorted(pair, np.arange(len(texts) + 1) * HASHED))


def _runs(solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _hashes(points: np.ndarray):
    up, down = powers(max(22, int(len(points) + 1).bit_length()))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    return lambda s, e: mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))


def votes(f: Facts) -> np.ndarray:
    """A row per text, a vote per labeller; a text without words has bad votes alone."""
    v = f.values
    few = v["n"] < 20  # too short for shares

    def vote(bad: np.ndarray, good: np.ndarray, abstain: np.ndarray | bool = False) -> np.ndarray:
        return np.where(abstain, 0, np.where(bad, -1, np.where(good, 1, 0)))

    out = np.stack(
        [
            vote(v["marks"] > 0.3, v["marks"] < 0.1),
            vote(v["letters"] < 0.75, v["letters"] > 0.9),
            vote(v["upper"] > 0.5, v["upper"] < 0.2),
            vote(v["again"] > 0.2, v["again"] < 0.05),
            vote(v["distinct"] < 0.25, v["distinct"] > 0.4, few | (v["n"] > 3000)),
            vote(v["ends"] < 0.005, (v["ends"] > 0.02) & (v["marks"] < 0.3), few),
            vote((v["mean"] < 2) | (v["mean"] > 25), (v["mean"] >= 3) & (v["mean"] <= 15)),
            vote(v["lines"] < 0.5, v["lines"] > 0.7, few),
            vote(v["glyphs"] > 0.2, v["glyphs"] < 0.05),
        ],
        axis=1,
    )
    out[v["n"] == 0] = -1
    return out.astype(np.int64)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """For each labeller the probabilities of its votes (-1, 1), where it votes, given bad and given good; the share of good.

    patterns: a row of votes each; counts: texts with that row. A labeller that doesn't vote says nothing. It starts
    from the majority, and each count has a prior of labellers better than chance, so that none is certain.
    """
    good = np.clip(0.5 + 0.45 * np.sign(patterns.sum(1)), 0.05, 0.95)
    weights = counts.astype(float)
    table = np.full((patterns.shape[1], 2, 2), 0.5)
    share = 0.5
    for _ in range(EM_ROUNDS):
        share = float((good * weights).sum() + 1) / (weights.sum() + 2)
        for k in range(patterns.shape[1]):
            for c, v in enumerate((-1, 1)):
                here = weights * (patterns[:, k] == v)
                table[k, 1, c] = (here * good).sum() + (2.0 if v == 1 else 1.0)
                table[k, 0, c] = (here * (1 - good)).sum() + (2.0 if v == -1 else 1.0)
        table /= table.sum(2, keepdims=True)
        good = posterior(patterns, table, share)
    return table, share


def posterior(patterns: np.ndarray, table: np.ndarray, share: float) -> np.ndarray:
    """The probability of good for each row of votes."""
    odds = np.full(len(patterns), np.log(share) - np.log(1 - share))
    for k in range(patterns.shape[1]):
        v = (patterns[:, k] + 1) // 2
        odds += np.where(patterns[:, k] == 0, 0.0, np.log(table[k, 1, v]) - np.log(table[k, 0, v]))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@functools.cache
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % HASHED


def features(f: Facts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of each text, as slots and values: shares of word shapes, and bins of the facts."""
    out = []
    for k, n in enumerate(f.values["n"].tolist()):
        a, b = f.begin[k], f.begin[k + 1]
        bins = [f"{name} {min(30, int(f.values[name][k])) if name == 'mean' else round(float(f.values[name][k]) * 10)}" for name in ("marks", "letters", "upper", "again", "distinct", "ends", "mean", "lines", "glyphs")]
        slots = [*map(_slot, bins), _slot(f"size {n.bit_length()}")]
        out.append((np.append(f.slots[a:b], slots), np.concatenate((f.counts[a:b] / max(1, n), [1.0] * len(bins), [0.5]))))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of soft labels, by Adam with decay."""
    weights, bias = np.zeros(HASHED), 0.0
    if not rows:
        return weights, bias
    slots = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    m, v = np.zeros(HASHED + 1), np.zeros(HASHED + 1)
    for step in range(1, EPOCHS + 1):
        z = np.bincount(owner, weights[slots] * values, len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        g = np.append(np.bincount(slots, error[owner] * values, HASHED) + 1e-5 * weights, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def vote_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and votes (as a string of -, 0, +) of each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = text_buffers(batch.column(1))
            for i, j in chunks(at, 1 << 20):
                cast = votes(facts_of([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]))
                got = ["".join("-0+"[v + 1] for v in row) for row in cast.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(got, pa.string())], names=["id", "votes"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("votes", T.StringType())])
    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, schema)


def _rows_of(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in p] for p in patterns], np.int64).reshape(len(patterns), len(LABELLERS))


def _sample(docs: DataFrame, cast: DataFrame, id_col: str, text_col: str) -> list[str]:
    place = F.xxhash64(F.col("id").cast("string"))
    ids = cast.select("id").where("id is not null").distinct().orderBy(place, "id").limit(TRAIN_ROWS)
    found = docs.select(F.col(f"`{id_col}`").alias("own"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = found.join(F.broadcast(ids), F.col("own") == F.col("id")).groupBy("id").agg(F.min("text").alias("text"))
    found = written(found.withColumn("place", place), "sample")
    sizes = found.select("place", "id", F.length("text").alias("n")).orderBy("place", "id").collect()  # TRAIN_ROWS at most
    some = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), TRAIN_POINTS, "right"))
    if some < len(sizes):
        found = found.where(F.struct("place", "id") < F.struct(F.lit(sizes[some]["place"]).alias("place"), F.lit(sizes[some]["id"]).alias("id")))
    return found.orderBy("place", "id").select("text").toArrow()["text"].to_pylist()


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: its id, weak_label (posterior of good from the votes), score (of the scorer) and kept (score >= 0.5).

    The votes are counted over all rows, by pattern (3^9 at most), and expectation-maximisation runs on the counts.
    The scorer learns the posteriors of at most TRAIN_ROWS rows, by a hash of the id (of equal ids the least text), and
    of them as many as have TRAIN_POINTS code points together; it scores every whole text.

    Null and empty texts have bad votes alone; texts of any length count whole. Rows repeated with one id each count and
    each give a row; ties in the order of the sample go by id; an empty table gives an empty result. Other columns of
    docs, whatever their names, play no part.
    """
    spark = docs.sparkSession
    cast = written(vote_table(docs, id_col, text_col), "votes")
    counts = cast.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # 3^9 rows at most
    patterns = _rows_of([r["votes"] for r in counts])
    table, share = expectation_maximisation(patterns, np.array([r["n"] for r in counts]))
    texts = _sample(docs, cast, id_col, text_col)
    rows, marks = [], [np.zeros((0, len(LABELLERS)), np.int64)]
    for part in range(0, len(texts), 300):
        f = facts_of(texts[part : part + 300])
        rows += features(f)
        marks.append(votes(f))
    target = posterior(np.concatenate(marks), table, share)
    model = spark.sparkContext.broadcast((*train(rows, target), table, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, table, share = model.value
        for batch in batches:
            _, at = text_buffers(batch.column(1))
            for i, j in chunks(at, 1 << 20):
                f = facts_of([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                weak = posterior(votes(f), table, share)
                scores = [bias + float(weights[slots] @ values) for slots, values in features(f)]
                scored = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(weak), pa.array(scored), pa.array(scored >= 0.5)], names=[id_col, "weak_label", "score", "kept"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), run, schema)
