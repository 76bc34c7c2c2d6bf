"""Secrets in texts: a keyword automaton finds places, anchored patterns match there, checksums confirm issued tokens."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, free, map_arrow, text_buffers

#: The base kinds, in the order in which spans of one start are listed, and the kinds with checksums.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "card", "iban")

#: The keywords of each kind.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("AKIA",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ISSUED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![0-9A-Za-z])[3-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])")
CARD_RUN = re.compile(r"[0-9 -]+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")

LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True
_DIGIT_BYTE = np.zeros(256, bool)
_DIGIT_BYTE[48:58] = True
_GAP_BYTE = np.zeros(256, bool)
_GAP_BYTE[[32, 45]] = True
_UPPER_BYTE = np.zeros(256, bool)
_UPPER_BYTE[[*range(48, 58), *range(65, 91)]] = True
#: For hex, card and iban: the bytes of a run, and how many there are at least.
RUNS = ((_HEX_BYTE, LEAST_HEX), (_DIGIT_BYTE | _GAP_BYTE, 16), (_UPPER_BYTE, 15))


def automaton() -> ahocorasick.Automaton:
    """All keywords in lower case; a hit gives the kinds and the keyword's length."""
    found: dict[str, list[str]] = {}
    for kind, words in KEYWORDS.items():
        for w in words:
            found.setdefault(w.lower(), []).append(kind)
    a = ahocorasick.Automaton()
    for w, kinds in found.items():
        a.add_word(w, (len(w), tuple(kinds)))
    a.make_automaton()
    return a


def checksum_holds(body: str, check: str) -> bool:
    """Whether the last six digits are the CRC-32 of the rest in base 62."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        out = _DIGITS[d] + out
    return out == check


def luhn_holds(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0 and len(set(digits)) > 1


def mod97_holds(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def long_runs(data: np.ndarray, at: np.ndarray, classes: np.ndarray, least: int) -> list[list[int]]:
    """For each text, where (in bytes) its runs of at least so many bytes of a class begin: the places that stand in for keywords."""
    lo, hi = int(at[0]), int(at[-1])
    inside = classes[data[lo:hi]]
    edge = np.zeros(hi - lo + 1, bool)
    edge[at - lo] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    found = start[end - start >= least] + lo
    cut = np.searchsorted(found, at)
    return [(found[a:b] - t).tolist() if b > a else [] for a, b, t in zip(cut[:-1].tolist(), cut[1:].tolist(), at[:-1].tolist())]


def code_points(data: bytes, places: list[int]) -> list[int]:
    """Byte places in UTF-8 as places in code points."""
    out, done, n = [], 0, 0
    for p in places:
        n += len(data[done:p].decode())
        done = p
        out.append(n)
    return out


class Scanner:
    def __init__(self) -> None:
        self.words = automaton()

    def spans(self, text: str, hexes: list[int] | None = None, cards: list[int] | None = None, ibans: list[int] | None = None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then kind. Base kinds are leftmost and don't overlap within a kind.

        hexes, cards, ibans: where runs of their bytes that are long enough begin, in bytes; they are looked for if not given.
        """
        if hexes is None:
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.array([0, len(raw)])
            (hexes,), (cards,), (ibans,) = (long_runs(raw, ends, c, n) for c, n in RUNS)
        out: list[tuple[str, int, int]] = []
        past = dict.fromkeys(KINDS, 0)
        low = text.encode().lower().decode()  # A-Z alone, so places stay the same
        hits = sorted((end + 1 - n, kinds) for end, (n, kinds) in self.words.iter(low))
        for start, kinds in hits:
            for kind in kinds:
                if start < past[kind]:
                    continue
                if kind == "assign":
                    if m := ASSIGN.match(text, start):
                        past[kind] = m.end()
                        if len(m[2]) >= LEAST_VALUE:
                            out.append((kind, start, m.end()))
                elif kind == "access":
                    if m := ACCESS.match(text, start):
                        past[kind] = m.end()
                        if m.end() - start >= LEAST_ACCESS:
                            out.append((kind, start, m.end()))
                elif (m := ISSUED.match(text, start)) and checksum_holds(m[1], m[2]):
                    past[kind] = m.end()
                    out.append((kind, start, m.end()))
        if (hexes or cards or ibans) and not text.isascii():
            hexes, cards, ibans = (code_points(text.encode(), x) for x in (hexes, cards, ibans))
        out += [("hex", s, HEX.match(text, s).end()) for s in hexes]
        for s in cards:  # a run of digits and gaps may hold several numbers, and begin with a gap
            end = CARD_RUN.match(text, s).end()
            out += [("card", m.start(), m.end()) for m in CARD.finditer(text, s, min(len(text), end + 1)) if luhn_holds(re.sub("[ -]", "", m[0]))]
        out += [("iban", s, m.end()) for s in ibans if (m := IBAN.match(text, s)) and mod97_holds(m[0])]
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, n_assign, n_access, n_hex, base_sha256 and spans (`kind:start:end`, comma-joined).

    Keywords, found by one automaton pass over the whole text, open the assign, access, github and npm kinds; hex
    runs, card and account numbers have no keyword, and patterns are tried where a long enough run of their bytes
    begins. Issued tokens count if their CRC-32 holds, card numbers if the Luhn sum does, account numbers if the
    remainder by 97 is 1.

    Null and empty texts have no spans; texts of any length are scanned whole; of keyword hits that lie in a match of
    their kind none opens another, and spans of different kinds that start together go by kind. Repeated rows have equal
    results; an empty table gives an empty one; columns of docs that are not in `keep` play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            data, at = text_buffers(batch.column(0))
            for i, j in chunks(at):
                part = at[i : j + 1]
                hexes, cards, ibans = (long_runs(data, part, c, n) for c, n in RUNS)
                counts: list[list[int]] = [[], [], []]
                digests, spans = [], []
                for k, text in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    found = scanner.spans(text or "", hexes[k], cards[k], ibans[k])
                    base = [s for s in found if s[0] in BASE]
                    for n, kind in zip(counts, BASE):
                        n.append(sum(s[0] == kind for s in base))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(found))
                made = [*(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(1 + n).slice(i, j - i) for n in range(len(keep))), *made], names=[*keep, *names])

    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType([*(docs.schema[k] for k in keep), *(T.StructField(n, k) for n, k in zip(names, kinds))])
    return map_arrow(docs.select(docs[text_col].alias(free("_text", docs)), *(docs[k] for k in keep)), run, schema)
