"""Personal data in texts, plain and disguised, with spans in the source text.

Plain identifiers are found first.  Then transducers rewrite a copy of the text:
look-alike characters to ASCII, spelled digits to digits, at/dot disguises to their marks.
Each keeps, for every character it writes, the source span it stands for, so whatever the same
detectors find in the rewritten text maps back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import ALNUM, Words, batch, slices, tidied, utf8, word_hashes

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# A match never begins within a run of digits: what fails at its first digit fails at all others.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """From each @, back over the characters of a local part: linear, unlike a search from every start."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def plain_spans(text: str) -> list[Span]:
    """The undisguised identifiers of a text, leftmost and without overlap within each kind."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return in_order(found)


def in_order(spans) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Cyrillic and Greek letters that look like Latin ones, and the letters they pass for.
_ALIKE_FROM = "АВЕКМНОРСТУХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαρυνικ"
_ALIKE_TO = "ABEKMHOPCTYXaeopcyxijsdqwABEZHIKMNOPTYXoapuvik"
# Marks that pass for a full stop, a hyphen, an at sign.
_MARKS = dict.fromkeys("。․·•", ".") | dict.fromkeys("‐‑‒–—−", "-") | dict.fromkeys("    ", " ")
# Characters without width.
_INVISIBLE = "​‌‍‎‏⁠﻿­"

# The digits 0 to 9 as words.
SPELLED = (
    ("zero", "oh", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
_VALUE = {w: str(k) for k, words in enumerate(SPELLED) for w in words}
_WORD = "(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + ")"
_DOT_WORD = "(?:dot|punkt|point|punto)"
_GAP = r"[\s().,_-]{1,3}"
# Blanks are matched possessively (``++``), and only from the first of a run on, so that no text takes more than linear time.
_AROUND_DOT = rf"\s*+[\[({{]?\s*+\b{_DOT_WORD}\b\s*+[\])}}]?\s*+"
#: Digits, some of them words: at least two spelled ones beside each other, or one beside digits after a plus.
_SPELLED_PAIR = re.compile(rf"\b{_WORD}{_GAP}(?:(?:double|triple)\s++)?{_WORD}\b|\b{_WORD}{_GAP}[0-9]|[0-9]{_GAP}{_WORD}\b|(?:\bplus\s++|\+\s*+){_WORD}\b", re.I)
_TOKEN = rf"(?:(?:(?:double|triple)\s++)?\b{_WORD}\b|[0-9]++)"
_RUN = re.compile(rf"(?:(?:\bplus\b|\+)[\s(]*+)?{_TOKEN}(?:(?:{_GAP}|{_AROUND_DOT}|\s*+\.\s*+)?{_TOKEN})++", re.I)
#: Tokens in a run at least, and spelled or written digits.
RUN_TOKENS = 4
_TOKENS = re.compile(rf"\b{_WORD}\b|[0-9]", re.I)
_IN_RUN = re.compile(rf"(?P<plus>\bplus\b\s*+)|(?P<twice>(?:double|triple)\s++)?\b(?P<word>{_WORD})\b|(?P<dot>(?<!\s){_AROUND_DOT})", re.I)
_BETWEEN_WORDS = re.compile(rf"(?<=[a-zß-ÿ])[\s,_-]{{1,3}}(?=(?:(?:double|triple)\s++)?{_WORD}\b)", re.I)

# What stands for an at sign or a full stop; the blanks around it go with it (see ``replace``).
_AT_BRACKET = re.compile(r"[\[({<]\s*+(?:at|@|arroba|arobase|ät)\s*+[\])}>]|&#64;|&commat;|%40|(?<=[A-Za-z0-9])_(?:at)_(?=[A-Za-z0-9])", re.I)
_DOT_BRACKET = re.compile(rf"[\[({{<]\s*+(?:{_DOT_WORD}|\.)\s*+[\])}}>]|&#46;|&period;|(?<=[A-Za-z0-9])_(?:dot)_(?=[A-Za-z0-9])", re.I)
_AT_SPACED = re.compile(r"(?<=[A-Za-z0-9])\s++@\s*+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\s++(?=[A-Za-z0-9])")
# In each language, the words for an at sign and a full stop; words of two languages make no address.
SPOKEN = (("at", "dot"), ("at", "punkt"), ("arobase", "point"), ("arroba", "punto"))


def _spoken(at: str, dot: str) -> str:
    """An address whose marks are words: after ``@`` any word for a full stop will do."""
    between = rf"\s{{1,3}}{dot}\s{{1,3}}"
    return rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:{between}[A-Za-z0-9_%+-]+){{0,3}}{at}[A-Za-z0-9-]+(?:(?:{between}|\.)[A-Za-z0-9-]+)*{between}[A-Za-z0-9-]+"


_BARE = re.compile("|".join([_spoken(rf"\s{{1,3}}{a}\s{{1,3}}", d) for a, d in SPOKEN] + [_spoken("@", _DOT_WORD)]), re.I)
_BARE_PARTS = re.compile(rf"\s{{1,3}}(?:(?P<at>at|arobase|arroba)|{_DOT_WORD})\s{{1,3}}", re.I)
_DOT_NUMBER = re.compile(rf"(?<=[0-9]){_AROUND_DOT}(?=[0-9])", re.I)
_DOT_SIGN = re.compile(rf"\b{_DOT_WORD}\b", re.I)
_SIGNAL = re.compile(rf"[\[({{<]\s*+(?:at|@|arroba|arobase|ät|\.|{_DOT_WORD})\s*+[\])}}>]|_(?:at|dot)_|\s@|@\s|&#64;|&#46;|&commat;|&period;|%40", re.I)


@lru_cache(1)
def _folding() -> tuple[dict, frozenset, re.Pattern]:
    """Look-alike characters and what they pass for, their set, and a pattern for invisible ones."""
    table = dict(zip(_ALIKE_FROM, _ALIKE_TO)) | _MARKS
    for first, last in ((0x2070, 0x2090), (0x2100, 0x2150), (0x2460, 0x24FF), (0x3000, 0x3001), (0xFE50, 0xFE70), (0xFF01, 0xFF5F), (0x1D400, 0x1D800), (0x660, 0x66A), (0x6F0, 0x6FA), (0x966, 0x970)):
        for code in range(first, last):
            c = chr(code)
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and (d := unicodedata.digit(plain, None)) is not None:
                plain = str(d)
            if len(plain) == 1 and plain.isascii() and plain != c:
                table.setdefault(c, plain)
    return {ord(k): v for k, v in table.items()}, frozenset(table), re.compile("[" + _INVISIBLE + "]")


class Rewriting:
    """A text under rewriting: for every character, the source span it stands for and whether it was written."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.begin = np.arange(len(text))
        self.end = self.begin + 1
        self.written = np.zeros(len(text), bool)

    def fold(self) -> None:
        table, alike, invisible = _folding()
        if not alike.isdisjoint(self.text):
            self.written |= np.fromiter((c in alike for c in self.text), bool, len(self.text))
            self.text = self.text.translate(table)
        self.edit([(m.start(), m.end(), "") for m in invisible.finditer(self.text)])

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, in order and without overlap; what is put in stands for all that it replaces."""
        if not edits:
            return
        text, begin, end, written, at = [], [], [], [], 0
        for a, b, put in edits:
            text += (self.text[at:a], put)
            begin += (self.begin[at:a], np.full(len(put), self.begin[a]))
            end += (self.end[at:a], np.full(len(put), self.end[b - 1]))
            written += (self.written[at:a], np.ones(len(put), bool))
            at = b
        text.append(self.text[at:])
        self.text = "".join(text)
        self.begin = np.concatenate([*begin, self.begin[at:]])
        self.end = np.concatenate([*end, self.end[at:]])
        self.written = np.concatenate([*written, self.written[at:]])

    def replace(self, pattern: re.Pattern, put: str) -> None:
        """Matches and the blanks around them become ``put``."""
        text, edits, done = self.text, [], 0
        for m in pattern.finditer(text):
            a, b = m.span()
            if a < done:  # the blanks before it went with the last one
                continue
            while a > done and text[a - 1].isspace():
                a -= 1
            while b < len(text) and text[b].isspace():
                b += 1
            edits.append((a, b, put))
            done = b
        self.edit(edits)

    def spelled(self) -> None:
        """Spelled digits in runs of at least four digits or words become digits; dots and a plus between them their marks."""
        edits = []
        for run in _RUN.finditer(self.text):
            if len(_TOKENS.findall(run.group())) < RUN_TOKENS or not re.search(_WORD, run.group(), re.I):
                continue
            at = run.start()
            gaps = [(at + m.start(), at + m.end(), "") for m in _BETWEEN_WORDS.finditer(run.group())]
            own = []
            for m in _IN_RUN.finditer(run.group()):
                if m["plus"]:
                    put = "+"
                elif m["dot"]:
                    put = "."
                else:
                    put = _VALUE[m["word"].lower()] * {"d": 2, "t": 3}.get((m["twice"] or " ")[0].lower(), 1)
                own.append((at + m.start(), at + m.end(), put))
            taken = {k for a, b, _ in own for k in range(a, b)}
            edits += sorted(own + [g for g in gaps if not any(k in taken for k in range(g[0], g[1]))])
        self.edit(edits)

    def bare(self) -> None:
        """``name at host dot tld``: only where both are words or the dot is."""
        edits = []
        for m in _BARE.finditer(self.text):
            edits += [(m.start() + p.start(), m.start() + p.end(), "@" if p["at"] else ".") for p in _BARE_PARTS.finditer(m.group())]
        self.edit(edits)


_SPELLED_HASHES = np.unique(word_hashes([*_VALUE, *(w.upper() for w in _VALUE)]))
_LEAD_HASHES = np.unique(word_hashes(["double", "triple", "plus"]))
_DOT_HASHES = np.unique(word_hashes(["dot", "punkt", "point", "punto"]))


def hints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per row: may it hold a run of spelled digits, and a spelled dot?  Computed on word hashes of the whole batch."""
    data, offsets = utf8(column)
    number, dots = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for lo, hi in slices(offsets):
        words = Words(data, offsets[lo : hi + 1], ALNUM)
        spelled = np.isin(words.hashes, _SPELLED_HASHES)
        begins = data[offsets[lo] : offsets[hi]][words.starts]
        near = spelled | ((begins >= 48) & (begins < 58)) | np.isin(words.hashes, _LEAD_HASHES)
        pair = np.zeros(len(spelled) + 1, bool)  # of word i - 1 and word i, one spelled and the other near
        pair[1:-1] = (spelled[:-1] & near[1:]) | (near[:-1] & spelled[1:])
        plus = data[offsets[lo] : offsets[hi]][np.maximum(words.starts - 1, 0)] == 43
        pair[:-1] |= spelled & plus
        dot = np.isin(words.hashes, _DOT_HASHES)
        for out, flags in ((number, pair[:-1]), (dots, dot)):
            total = np.concatenate([[0], np.cumsum(flags)])[words.first]
            out.append(np.diff(total) > 0)
    return np.concatenate(number), np.concatenate(dots)


_MARKED = re.compile(r"[\[({<@_&%]")


def disguised_spans(text: str, number: bool | None = None, dots: bool | None = None) -> list[Span]:
    """Identifiers that show only after rewriting, as spans of the source.  ``number`` and ``dots``: what ``hints`` says."""
    folded = False
    if not text.isascii():
        _, alike, invisible = _folding()
        folded = not alike.isdisjoint(text) or bool(invisible.search(text))
    signal = bool(_MARKED.search(text) and _SIGNAL.search(text))
    if number is None:
        number = bool(_SPELLED_PAIR.search(text))
    if dots is None:
        dots = bool(_DOT_SIGN.search(text))
    if not (folded or signal or number or dots):
        return []
    copy = Rewriting(text)
    if folded:
        copy.fold()
        signal, number, dots = (bool(p.search(copy.text)) for p in (_SIGNAL, _SPELLED_PAIR, _DOT_SIGN))
    if signal:
        copy.replace(_AT_BRACKET, "@")
        copy.replace(_DOT_BRACKET, ".")
        copy.replace(_AT_SPACED, "@")
    if number:
        copy.spelled()
    if dots:
        copy.replace(_DOT_NUMBER, ".")
        copy.bare()
    if not copy.written.any() and copy.text == text:
        return []
    found = []
    for kind, a, b in plain_spans(copy.text):
        begin, end = int(copy.begin[a]), int(copy.end[b - 1])
        # Removed characters leave no trace but a gap in the source.
        if copy.written[a:b].any() or end - begin != b - a:
            found.append((kind, begin, end))
    return found


def all_spans(text: str, number: bool | None = None, dots: bool | None = None) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans).  A disguised one that lies within a plain one of its kind adds nothing."""
    plain, more = plain_spans(text), disguised_spans(text, number, dots)
    if more:
        own = {kind: [(a, b) for k, a, b in plain if k == kind] for kind in KINDS}  # in order and disjoint

        def within(kind: str, a: int, b: int) -> bool:
            k = bisect_right(own[kind], (a, len(text) + 1)) - 1
            return k >= 0 and b <= own[kind][k][1]

        more = [s for s in more if not within(*s)]
    return plain, in_order(plain + more) if more else plain


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _find(batches):
    for b in batches:
        out = {k: [] for k in _FOUND.names[1:]}
        for value, number, dots in zip(b.column(1), *hints(b.column(1))):
            plain, every = all_spans(value.as_py() or "", number, dots)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in plain))
            out["base_sha256"].append(hashlib.sha256(joined(plain).encode()).hexdigest())
            out["spans"].append(joined(every))
        yield batch({"doc_id": b.column(0)} | out, _FOUND)


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text.

    Input: ``doc_id`` and ``text``; other columns are ignored.  Output, one row per input row:
    ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (plain identifiers), ``base_sha256`` (digest of
    the plain spans) and ``spans`` (all spans, plain and disguised, as kind:start:end in code
    points, end exclusive, by start, then kind).  Whole texts of any length are read, in time that grows with
    the length, whatever they hold.  A null text is empty and has none; a null
    doc_id stays null; repeated rows get equal results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidied(_find), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, number: bool | None = None, dots: bool | None = None) -> str:
    """The text with every identifier replaced by its kind in angle brackets; overlapping ones by the first's."""
    _, spans = all_spans(text, number, dots)
    out, at = [], 0
    k = 0
    while k < len(spans):
        kind, a, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += (text[at:a], f"<{kind.upper()}>")
        at = b
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their texts redacted, all columns; a null text stays null."""
    place = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(place)
            new = [None if t is None else redacted(t, n, d) for t, n, d in zip((x.as_py() for x in texts), *hints(texts))]
            yield b.set_column(place, b.schema.field(place), pa.array(new, texts.type))

    return docs.mapInArrow(tidied(run), docs.schema)
