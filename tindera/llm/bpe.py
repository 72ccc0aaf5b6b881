"""Byte-level BPE over whole batches: texts are cut into pre-tokens with array
operations, each distinct pre-token meets the tokenizer once, and ids or counts
are gathered from there.

Results equal the library's own ``encode(text, add_special_tokens=False)``; texts
that hold an added token's string go through the library as they are.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .arrowtext import mix

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK = 1 << 20
MOST_KNOWN = 1 << 19  # pre-tokens that a worker remembers; beyond, it starts anew


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for name, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m.group()[0]), ord(m.group()[-1])
            table[a : b + 1] = name
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(1)
def _point_names() -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cuts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts laid end to end.

    ``points``: code points; ``offsets``: where texts begin, and the end.  The rule is
    that of byte-level BPE: an English contraction; one blank and then letters, or
    numbers, or other marks; white space up to the last one before a word; white space.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # White space gives its last blank to the word that follows; its last other mark stands alone.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n]
    at = np.flatnonzero(last)
    start[at] = True
    joined = at[points[at] == 32] + 1
    start[joined] = False
    # Contractions: a lone apostrophe that begins a pre-token and stands before its letters.
    mark = np.flatnonzero((points == 39) & start)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~edge[mark + 1]]
    if len(mark):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[mark + 1], padded[mark + 2]
        two = np.where(edge[np.minimum(mark + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((short, 1), (long & ~short, 2)):
            m = mark[hit]
            start[m + 1] = False
            rest = m + 1 + size
            start[rest[rest < n]] = True
    return np.flatnonzero(start)


class Pieces:
    """A tokenizer with what it has learnt of pre-tokens so far."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]
        self.forget()
        self._power = np.ones(0, np.uint64)

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted
        self.where = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self.known) > MOST_KNOWN:
            self.forget()
        size, flat = self.pieces(texts)
        n = len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, flat])
        known, where = np.concatenate([self.known, hashes]), np.concatenate([self.where, np.arange(n, n + len(hashes))])
        order = np.argsort(known, kind="stable")
        self.known, self.where = known[order], where[order]

    def pieces(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each pre-token has, and all ids in order."""
        sizes, ids = [], []
        for k in range(0, len(pretokens), 8192):
            part = pretokens[k : k + 8192]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
            ids.append(np.array(found.ids, np.uint32))
        return np.concatenate(sizes), np.concatenate(ids)

    def pretokens(self, texts: list[str]):
        """Distinct pre-tokens of some texts: hashes, their strings (by index), each occurrence's index, and occurrences by text."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        starts = cuts(points, offsets)
        if not len(starts):
            return np.zeros(0, np.uint64), [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(points))
        if len(self._power) <= len(points):
            base = np.full(max(len(points) + 1, CHUNK), 0x9E3779B97F4A7C15, np.uint64)
            base[0] = 1
            self._power = np.multiply.accumulate(base)
            base = np.full(len(base), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
            base[0] = 1
            self._inverse = np.multiply.accumulate(base)
        total = np.empty(len(points) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_point_names()[points] * self._power[: len(points)], out=total[1:])
        hashes = mix(((total[ends] - total[starts]) * self._inverse[starts]) ^ (ends - starts).astype(np.uint64))
        distinct, at, index = np.unique(hashes, return_index=True, return_inverse=True)
        s, e = starts[at], ends[at]
        return distinct, [(joined, s, e)], index, np.searchsorted(starts, offsets)

    def lookup(self, distinct: np.ndarray, source: list) -> np.ndarray:
        """Where each distinct pre-token's ids are; new ones meet the tokenizer now."""
        if not len(distinct):
            return np.zeros(0, np.int64)
        spot = np.searchsorted(self.known, distinct)
        there = np.zeros(len(distinct), bool)
        inside = spot < len(self.known)
        there[inside] = self.known[spot[inside]] == distinct[inside]
        if not there.all():
            joined, s, e = source[0]
            if len(self.known) > MOST_KNOWN:
                self.forget()
                there[:] = False
            new = np.flatnonzero(~there)
            self._learn(distinct[new], [joined[a:b] for a, b in zip(s[new].tolist(), e[new].tolist())])
            spot = np.searchsorted(self.known, distinct)
        return self.where[spot]

    def encode(self, texts: list[str]):
        """For each text its ids, as arrays."""
        plain = [not any(s in t for s in self.special) for t in texts]
        distinct, source, index, first = self.pretokens([t if p else "" for t, p in zip(texts, plain)])
        where = self.lookup(distinct, source)[index] if len(index) else np.zeros(0, np.int64)
        begin = self.first[where]
        size = self.first[where + 1] - begin if len(where) else begin
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(n) + np.repeat(begin - (ends - size), size)] if n else np.zeros(0, np.uint32)
        bound = np.concatenate([[0], ends])[first]
        return [flat[bound[i] : bound[i + 1]] if plain[i] else self.library(t) for i, t in enumerate(texts)]


@lru_cache(4)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def text_chunks(column: pa.Array, limit: int = CHUNK):
    """Row ranges of a string column with their texts (null: empty), about ``limit`` characters at once."""
    texts, at, size = [], 0, 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= limit:
            yield at, i + 1, texts
            texts, at, size = [], i + 1, 0
    if texts:
        yield at, len(column), texts
