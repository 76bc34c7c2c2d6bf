"""Toxicity scores from averaged subword embeddings under a linear softmax, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free, map_arrow, mix64, text_buffers, written
from .shingles import powers

#: Rows of the training sample at most, and code points of all its texts together.
TRAIN_ROWS, TRAIN_POINTS = 3000, 10_000_000
BUCKETS, DIM, GRAMS = 1 << 20, 4, (3, 4, 5)


@dataclass(frozen=True)
class Settings:
    """How a model is trained. The defaults are the best of a grid by cross_validated() on rows that aren't held out."""

    epochs: int = 60
    rate: float = 0.3
    sharpness: float = 60.0  # by which the mean over a text's words is multiplied
    pseudo: float = 300.0  # texts at the overall share of ones that are added to each subword's counts
    least_ratio: float = 0.2  # subwords whose log ratio is smaller have no vector


_U = np.uint64
_SPACE = np.zeros(128, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Bags:
    """Texts as bags of distinct words, words as bags of hashed subwords."""

    word: np.ndarray  # of each occurrence
    first: np.ndarray  # occurrence of each text (len + 1)
    gram: np.ndarray  # bucket
    begin: np.ndarray  # of each distinct word in gram (len + 1)
    key: np.ndarray  # hash of each distinct word


def _hashes(points: np.ndarray):
    up, down = powers(max(22, int(len(points) + 1).bit_length()))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + _U(1)) * up[: len(points)], out=sums[1:])
    return lambda s, e: mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))


def bags(texts: list[str]) -> Bags:
    """Words are runs without white space, in lower case; subwords are the word between marks and its 3- to 5-grams."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le"), np.uint32)
    solid = ~(_SPACE[np.minimum(points, 127)] & (points < 128))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in low)])
    first = np.searchsorted(starts, at)
    key, sample, word = np.unique(_hashes(points)(starts, ends), return_index=True, return_inverse=True)
    starts, sizes = starts[sample], (ends - starts)[sample] + 2  # with a mark at each end
    own = np.cumsum(np.append(0, sizes))
    flat = np.full(own[-1], ord("\n"), np.uint32)
    inner = np.ones(own[-1], bool)
    inner[own[:-1]] = inner[own[1:] - 1] = False
    place = np.arange(own[-1]) - np.repeat(own[:-1], sizes)
    flat[inner] = points[(np.repeat(starts, sizes) + place - 1)[inner]]
    hashed = _hashes(flat)
    left = np.repeat(own[1:], sizes) - np.arange(own[-1])  # code points up to the word's end
    found = [hashed(own[:-1], own[1:])]
    owner = [np.arange(len(sizes))]
    for n in GRAMS:
        s = np.flatnonzero(left >= n)
        found.append(hashed(s, s + n))
        owner.append(np.searchsorted(own, s, "right") - 1)
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    gram = (np.concatenate(found)[order] % _U(BUCKETS)).astype(np.int32)
    return Bags(word.reshape(-1).astype(np.int32), first, gram, np.searchsorted(owners[order], np.arange(len(sizes) + 1)), key)


def many_bags(texts: list[str], chars: int = 1 << 20) -> Bags:
    """bags() of many texts, some at a time, so that memory beyond the result doesn't grow with them."""
    parts, i = [], 0
    while i < len(texts) or not parts:
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= chars):
            n += len(texts[j])
            j += 1
        parts.append(bags(texts[i:j]))
        i = j
    key, sample, place = np.unique(np.concatenate([p.key for p in parts]), return_index=True, return_inverse=True)
    place = place.reshape(-1).astype(np.int32)
    words, firsts, at, shift = [], [np.zeros(1, np.int64)], 0, 0
    starts, ends, grams = [], [], 0
    for p in parts:
        words.append(place[at : at + len(p.key)][p.word])
        firsts.append(p.first[1:] + shift)
        starts.append(p.begin[:-1] + grams)
        ends.append(p.begin[1:] + grams)
        at, shift, grams = at + len(p.key), shift + len(p.word), grams + len(p.gram)
    start, size = np.concatenate(starts)[sample], (np.concatenate(ends) - np.concatenate(starts))[sample]
    begin = np.cumsum(np.append(0, size))
    every = np.concatenate([p.gram for p in parts])
    gram = every[np.arange(begin[-1]) + np.repeat(start - begin[:-1], size)]
    return Bags(np.concatenate(words), np.concatenate(firsts), gram, begin, key)


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of values (rows) over begin[i]:begin[i + 1], 0 for empty runs."""
    out = np.zeros((len(begin) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        out[full] = np.add.reduceat(values, begin[full], axis=0)
    return out


@dataclass
class Model:
    score: np.ndarray  # of each bucket: its embedding's part in the log odds, times the sharpness
    bias: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        b = bags(texts)
        word = _sums(self.score[b.gram], b.begin) / np.maximum(np.diff(b.begin), 1)
        total = _sums(word[b.word], b.first)
        z = self.bias + total / np.maximum(np.diff(b.first), 1)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _log_ratios(b: Bags, labels: np.ndarray, pseudo: float) -> np.ndarray:
    """For each bucket, the smoothed log ratio of its document frequencies under label 1 and label 0; 0 if it is in no text."""
    share = float(np.mean(labels))
    found = np.zeros((2, BUCKETS))
    for text, label in enumerate(labels):
        words = np.unique(b.word[b.first[text] : b.first[text + 1]])
        runs = [b.gram[b.begin[w] : b.begin[w + 1]] for w in words]
        if runs:
            found[label, np.unique(np.concatenate(runs))] += 1
    n = np.bincount(labels, minlength=2)
    prior = pseudo * np.array([1 - share, share])
    odds = [np.log((found[k] + prior[k]) / (n[k] + prior[k])) for k in (0, 1)]
    ratio = odds[1] - odds[0]
    ratio[found.sum(0) == 0] = 0
    return ratio.astype(np.float32)


def train(texts: list[str], labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Embeddings and softmax weights together, by gradient steps over all texts.

    A subword's vector is scaled by the square of its smoothed log ratio, and starts at that ratio along one direction, so that
    rare subwords, which could tell single training texts apart, count and move little. Texts of no or one class
    give the share of ones as every score.
    """
    ones = float(np.mean(labels)) if len(labels) else 0.0
    prior = float(np.clip(ones, 1e-3, 1 - 1e-3))
    bias = float(np.log(prior / (1 - prior)))
    if not len(labels) or ones in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), bias)
    b = many_bags(texts)
    n_words, n_texts = len(b.begin) - 1, len(texts)
    ratio = _log_ratios(b, labels, settings.pseudo)
    size = np.diff(b.first)
    pair = np.repeat(np.arange(n_texts), size) * np.int64(n_words) + b.word
    pair, count = np.unique(pair, return_counts=True)
    text, word = pair // n_words, pair % n_words
    weight = (settings.sharpness * count / size[text]).astype(np.float32)[:, None]
    text_begin = np.searchsorted(text, np.arange(n_texts + 1))
    by_word = np.argsort(word, kind="stable")
    word_begin = np.searchsorted(word[by_word], np.arange(n_words + 1))
    telling = np.abs(ratio) >= settings.least_ratio
    holder = np.repeat(np.arange(n_words, dtype=np.int32), np.diff(b.begin))[telling[b.gram]]
    begin = np.searchsorted(holder, np.arange(n_words + 1))
    used, gram = np.unique(b.gram[telling[b.gram]], return_inverse=True)
    by_gram = np.argsort(gram, kind="stable")
    gram_begin = np.searchsorted(gram[by_gram], np.arange(len(used) + 1))
    owner = holder[by_gram]
    share = (1 / np.diff(b.begin)).astype(np.float32)[:, None]
    scale = ratio[used][:, None] ** 2

    rng = np.random.default_rng(11)
    start = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    start[:, 0] += 1 / ratio[used]
    params = [start, np.zeros((DIM, 2), np.float32), np.log([1 - prior, prior]).astype(np.float32)]
    params[1][0] = (-0.5, 0.5)
    moved = [np.zeros_like(p) for p in params]
    spread = [np.zeros_like(p) for p in params]
    target = np.eye(2, dtype=np.float32)[labels]
    for step in range(settings.epochs):
        e, w, c = params
        words = _sums((e * scale)[gram], begin) * share
        hidden = _sums(words[word] * weight, text_begin)
        if not step:  # start from an unbiased softmax
            middle = hidden.mean(0) @ w
            params[2] = c = c - middle
        logits = hidden @ w + c
        p = np.exp(logits - logits.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - target) / n_texts
        back = error @ w.T
        to_words = _sums((back[text] * weight)[by_word], word_begin) * share
        grads = [_sums(to_words[owner], gram_begin) * scale, hidden.T @ error, error.sum(0)]
        for i, g in enumerate(grads):
            moved[i] = 0.9 * moved[i] + 0.1 * g
            spread[i] = 0.99 * spread[i] + 0.01 * g * g
            near = np.sqrt(spread[i] / (1 - 0.99 ** (step + 1))) + 1e-9
            params[i] = params[i] - settings.rate * moved[i] / (1 - 0.9 ** (step + 1)) / near
    e, w, c = params
    score = np.zeros(BUCKETS, np.float32)
    score[used] = settings.sharpness * ((e * scale) @ (w[:, 1] - w[:, 0]))
    return Model(score, float(c[1] - c[0]))


def cross_validated(texts: list[str], labels: np.ndarray, settings: Settings = Settings(), folds: int = 4) -> dict[str, float]:
    """Log loss, precision and recall over all rows, each scored by a model of the other folds. For rows that aren't held out."""
    fold = np.arange(len(texts)) % folds
    p = np.zeros(len(texts))
    for k in range(folds):
        rest = np.flatnonzero(fold != k)
        model = train([texts[i] for i in rest], labels[rest], settings)
        some = np.flatnonzero(fold == k)
        for at in range(0, len(some), 200):
            p[some[at : at + 200]] = model.probabilities([texts[i] for i in some[at : at + 200]])
    near = np.clip(np.where(labels == 1, p, 1 - p), 1e-9, 1)
    hit = float(((p >= 0.5) & (labels == 1)).sum())
    return {"loss": float(-np.log(near).mean()), "precision": hit / max(1, (p >= 0.5).sum()), "recall": hit / max(1, labels.sum())}


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> tuple[list[str], np.ndarray]:
    """Labelled rows that are not held out, by a hash of the id: at most TRAIN_ROWS, and of them as many as have TRAIN_POINTS
    code points together. An id that several rows have counts once, with the least of their texts and the greatest label."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    ids = known.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(TRAIN_ROWS)
    found = docs.select(F.col(id_col).alias("_own"), F.coalesce(text_col, F.lit("")).alias("_text"))
    rows = found.join(F.broadcast(ids), F.col("_own") == F.col("_id")).groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    rows = written(rows.withColumn("_place", F.xxhash64(F.col("_id").cast("string"))), "sample")
    sizes = rows.select("_place", "_id", F.length("_text").alias("_n")).orderBy("_place", "_id").collect()  # TRAIN_ROWS at most
    total = np.cumsum([r["_n"] for r in sizes])
    some = int(np.searchsorted(total, TRAIN_POINTS, "right"))
    if some < len(sizes):
        rows = rows.where(F.struct("_place", "_id") < F.struct(F.lit(sizes[some]["_place"]).alias("_place"), F.lit(sizes[some]["_id"]).alias("_id")))
    got = rows.orderBy("_place", "_id").select("_text", "_label").toArrow()
    return got["_text"].to_pylist(), np.minimum(got["_label"].to_numpy(), 1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the labelled rows that are not held out; labels other than 0 count as 1. It sees texts alone."""
    return train(*sample(docs, labels, label_col, id_col, text_col))


def score_table(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs and each whole text's score (0 to 1); null and empty texts get the model's prior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = text_buffers(batch.column(0))
            for i, j in chunks(at, 1 << 20):
                p = shared.value.probabilities([t or "" for t in batch.column(0).slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + n).slice(i, j - i) for n in range(len(keep))), pa.array(p)], names=[*keep, into])

    schema = T.StructType([*(docs.schema[k] for k in keep), T.StructField(into, T.DoubleType())])
    return map_arrow(docs.select(docs[text_col].alias(free("_text", docs)), *(docs[k] for k in keep)), run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, also for repeated rows, in any order.

    Null and empty texts and texts of white space get the model's prior; texts of any length are scored whole. Without
    labels of both classes the share of ones is every score. A null id is held out as its (null) remainder says: never,
    so held_out is false. Ties in the training order go by id. An empty table gives an empty result; other columns of
    docs play no part.
    """
    scored = score_table(docs, fit(docs, labels))
    out = F.coalesce(held_out(), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; all columns as they are, whatever their names.

    Null and empty texts have the model's prior as score and stay unless most training texts are toxic; repeated rows
    are decided alike; an empty table stays empty.
    """
    names = tuple(docs.columns)
    into = free("_toxicity", docs)
    scored = score_table(docs, fit(docs, labels), into=into, keep=names)
    return scored.where(F.col(into) < threshold).select(*(F.col(f"`{c}`") for c in names))
