"""Byte-pair encoding and decoding with a given vocabulary, by numpy merge rounds over many words at once."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, free, map_arrow, text_buffers

#: The vocabulary that encode_table takes if no path is given, by its name in the package of public tokenizers.
DEFAULT_NAME = "word_bpe_49k.json"

#: Words whose tokens a worker remembers.
REMEMBERED = 300_000
_NONE = np.int64(1 << 40)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_NAME)


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A lower-casing, white-space-dropping byte-level BPE vocabulary with word ends, in the tokenizers library's JSON."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = _byte_letters()
        self.inner = np.array([ids.get(c, -1) for c in letters], np.int64)
        self.final = np.array([ids.get(c + end, -1) for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[str] = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for text, i in (*ids.items(), *self.special.items()):
            self.tokens[i] = text
        born = np.full(len(self.tokens), _NONE)
        np.minimum.at(born, made, np.arange(len(made)))
        born[born == _NONE] = -1
        by_rank = np.arange(len(keys))
        #: Whether each merge makes a symbol that only later merges use; all places of one pair can then merge at once.
        self.in_order = bool(np.all((born[keys >> 32] < by_rank) & (born[keys & 0xFFFFFFFF] < by_rank))) and len(set(made.tolist())) == len(made)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = split

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words (none empty), one after another, and where each word's begin (len + 1)."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(sizes) - 1
        symbols[last] = self.final[data[last]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            key = (symbols[:-1] << 32) | symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            found = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(found, self.ranks[at], _NONE), _NONE)
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(heads, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, heads), lengths)
            busy = best < _NONE
            if not busy.all():
                done.append((symbols[~busy], owner[~busy]))
            hit = np.flatnonzero((rank == best) & busy)
            if not len(hit):
                break
            if self.in_order:  # in a run of one symbol, every other place merges
                fresh = np.append(True, np.diff(hit) != 1)
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            else:
                hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
            symbols[hit] = self.made[at[hit]]
            busy[hit + 1] = False
            symbols, owner = symbols[busy], owner[busy]
        tokens, owners = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(owners, kind="stable")
        tokens, owners = tokens[order], owners[order]
        known = tokens >= 0  # a byte without a symbol has no token
        return tokens[known], np.searchsorted(owners[known], np.arange(len(words) + 1))


class Encoder:
    """Encodes texts; remembers the words it has met."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.words = regex.compile(vocabulary.split)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self._forget()

    def _forget(self) -> None:
        special = list(self.v.special)
        self.at = {w: i for i, w in enumerate(special)}
        self.flat = np.array([self.v.special[w] for w in special], np.int64)
        self.begin = np.arange(len(special) + 1)
        self.decoded = special[:]

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.cut is not None and "<|" in text and self.cut.search(text):
            out: list[str] = []
            for i, part in enumerate(self.cut.split(text)):
                out += [part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.words.findall(text.lower())

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Token ids and the decoded text of each text."""
        if len(self.at) > REMEMBERED:
            self._forget()
        lists = [self._words(t) for t in texts]
        new = list({w for ws in lists for w in ws}.difference(self.at))
        if new:
            flat, begin = self.v.merge([w.encode() for w in new])
            n = len(self.decoded)
            self.at.update(zip(new, range(n, n + len(new))))
            tokens = self.v.tokens
            names = [tokens[i] for i in flat.tolist()]
            edges = begin.tolist()
            self.decoded += [" ".join(names[a:b]) for a, b in zip(edges, edges[1:])]
            self.begin = np.append(self.begin, begin[1:] + len(self.flat))
            self.flat = np.append(self.flat, flat)
        at, decoded = self.at, self.decoded
        for ws in lists:
            index = [at[w] for w in ws]
            i = np.array(index, np.int64)
            sizes = self.begin[i + 1] - self.begin[i]
            ends = np.cumsum(sizes)
            ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[i] - ends + sizes, sizes)]
            yield ids, " ".join([decoded[k] for k in index])


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The library's decode() for a vocabulary without decoder: the tokens, joined by spaces."""
    return " ".join([vocabulary.tokens[i] for i in ids])


FIELDS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode_table(docs: DataFrame, path: str | None = None, text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, and of the whole text encoded and decoded again those of FIELDS in outputs.

    Null text counts as empty: no tokens, and an empty decoded text. The strings of special tokens in a text become
    their ids, as in the library. A row's result depends on its text alone: repeated rows have equal results, and texts of
    any length are encoded whole, some megabytes of texts at a time. An empty table gives an empty result; columns of docs
    that are not in `keep` play no part, and one in `keep` must not have a name of outputs. The file at path (default_path()
    if not given) is read on the driver and sent to the executors; its size doesn't depend on docs.
    """
    if clash := set(keep) & set(outputs):
        raise ValueError(f"{sorted(clash)} are both kept and made")
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            column = batch.column(0)
            _, at = text_buffers(column)
            for i, j in chunks(at):
                got: dict[str, list] = {k: [] for k in outputs}
                for ids, decoded in encoder.encode([t or "" for t in column.slice(i, j - i).to_pylist()]):
                    for k, out in got.items():
                        if k == "n_tokens":
                            out.append(len(ids))
                        elif k == "ids":
                            out.append(ids.astype(np.int32))
                        elif k == "decoded":
                            out.append(decoded)
                        elif k == "ids_sha256":
                            out.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                        else:
                            out.append(hashlib.sha256(decoded.encode()).hexdigest())
                made = [pa.array(got[k], pa.list_(pa.int32()) if k == "ids" else pa.int64() if k == "n_tokens" else pa.string()) for k in outputs]
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + n).slice(i, j - i) for n in range(len(keep))), *made], names=[*keep, *outputs])

    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(k, FIELDS[k]) for k in outputs)])
    return map_arrow(docs.select(docs[text_col].alias(free("_text", docs)), *(docs[k] for k in keep)), run, schema)
