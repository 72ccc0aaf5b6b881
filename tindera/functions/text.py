"""Text normalisation, keys and parsing.  Column functions."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from .numbers import compact_number, leading_compact_number

# Spellings and the words they stand for.
SPELLINGS = {
    "dizapoytedd": "disappointed",
    "hnd": "hindi",
    "hndi": "hindi",
    "ndi": "hindi",
    "wlang": "walang",
    "sobranggg": "sobrang",
}
KEY_SEPARATOR = "\x1f"
_WORDS = re.compile(r"\w+")
KEY_BYTES = 16


@lru_cache
def _any_spelling(spellings: tuple[str, ...]) -> re.Pattern:
    """Whole words that are one of these spellings."""
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, spellings))})(?!\w)")


def normalised(text: str | None, spellings: Mapping[str, str] = SPELLINGS) -> str:
    """Compatibility form, plain apostrophes, single blanks, case-folded, with known spellings replaced."""
    value = text or ""
    if not value.isascii():
        value = unicodedata.normalize("NFKC", value).replace("’", "'")
    value = " ".join(value.replace("`", "'").split()).casefold()
    if any(s in value for s in spellings):
        value = _any_spelling(tuple(spellings)).sub(lambda m: spellings[m[0]], value)
    return value


def folded(text: Column) -> Column:
    """Case-folded by built-in functions: full upper case first, so that ß and ss are alike, and one small sigma."""
    return F.translate(F.lower(F.upper(text)), "ς", "σ")


class _Kept(dict):
    """What ``marks`` makes of each code point: itself or a blank; filled as code points are met."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        made = self[code] = code if c.isalnum() or c == "_" or unicodedata.category(c)[0] in "SM" else 32
        return made


_kept = _Kept()


def marks(text: str) -> str:
    """Letters, digits, underscores, symbols and marks; all else is one blank."""
    return " ".join(text.translate(_kept).split())


@F.pandas_udf(StringType())
def normalise(texts: pd.Series) -> pd.Series:
    return texts.map(normalised)


@F.pandas_udf(StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """What duplicate texts have in common: emoji count, punctuation doesn't."""
    return texts.map(lambda t: marks(normalised(t)))


def _key(text: str | None) -> bytes | None:
    plain = marks(normalised(text))
    return hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=KEY_BYTES).digest() if plain else None


def _keys(texts: pd.Series) -> pd.Series:
    return texts.map(_key)


def fingerprint_key(text: Column) -> Column:
    """A 128-bit digest of the fingerprint, null if that is empty: what duplicates are grouped and joined by.

    It counts as non-deterministic for the optimiser only, so that filters on it don't compute it again.
    """
    return F.pandas_udf(_keys, BinaryType()).asNondeterministic()(text)


def slug(text: Column, default: str = "search") -> Column:
    made = F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(made, F.lit("")), F.lit(default))


def repaired(value: str | None, markers: Sequence[str] = ("â", "Â")) -> str:
    """Text whose UTF-8 was read as a one-byte encoding, read again; then single blanks."""
    text = value or ""
    if any(m in text for m in markers):
        for encoding in ("cp1252", "latin-1"):
            try:
                text = text.encode(encoding).decode("utf-8")
            except UnicodeError:
                continue
            break
    return " ".join(text.replace("\xa0", " ").split())


@F.pandas_udf(StringType())
def repair(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


def price_from_text(text: Column) -> Column:
    """The first peso price or price range, without blanks; empty without one."""
    found = F.regexp_extract(text, r"(₱\s*[0-9.,]+(?:\s*-\s*₱?\s*[0-9.,]+)?)", 1)
    return F.regexp_replace(found, r"\s+", "")


# What a filter button's label must begin with, or hold, for its key.
FILTER_LABELS = (
    ("all", "begins", ("all", "tất cả")),
    ("commented", "holds", ("comment", "bình luận")),
    ("media", "holds", ("media", "photo", "video", "hình ảnh")),
)


def rating_filter(label: Column) -> Column:
    """(key, count) of a filter button such as ``5 Star (1.2K)``; an empty key for other labels."""
    shown = F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " "))
    low = F.lower(shown)
    key = F.lit("")
    for name, how, words in reversed(FILTER_LABELS):
        hits = [low.startswith(w) if how == "begins" else low.contains(w) for w in words]
        key = F.when(reduce(or_, hits), name).otherwise(key)
    digit = F.left(shown, F.lit(1))
    alone = shown.rlike(r"^.(?U)(?i)(?:\s*(?:stars?|sao))?(?!\w)")
    key = F.when(digit.isin(*"12345") & alone, F.concat(digit, F.lit("_star"))).otherwise(key)
    return F.struct(key.alias("key"), compact_number(F.regexp_extract(shown, r"\(([^)]*)\)", 1)).alias("count"))


def sold_count(text: Column) -> Column:
    return leading_compact_number(F.regexp_extract(text, r"(?i)([0-9][0-9,.]*\s*[kmb]?)\+?\s*(?:sold|bought)", 1))


def review_count(text: Column) -> Column:
    return leading_compact_number(F.regexp_extract(text, r"(?i)([0-9][0-9,.]*\s*[kmb]?)\+?\s*(?:reviews?|ratings?)", 1))


def shipping_line(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.lower(x).contains("shipping"))
    return F.when(F.size(lines) > 0, F.element_at(lines, 1)).otherwise("")


def term_regex(term: str) -> str:
    """A term as a whole, in any case, with any white space between its words."""
    return r"(?iU)(?<!\w)" + r"\s+".join(re.escape(w) for w in term.split()) + r"(?!\w)"


NO_TEXT = "No written review"


def highlighted(text: str | None, terms: Sequence[str], start: str = "<mark>", end: str = "</mark>") -> str:
    """Escaped for HTML, with every occurrence of the terms marked in any case: the longest first, so that a shorter one may nest.

    Terms of one length keep their order by name; terms may match anywhere, also inside words and in marks that are
    there already.  An empty text has a notice in its place.
    """
    safe = html.escape(str(text or NO_TEXT))
    for term in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)):
        safe = re.sub(re.escape(html.escape(term)), lambda m: f"{start}{m[0]}{end}", safe, flags=re.I)
    return safe


@F.pandas_udf(StringType())
def _highlight(texts: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([highlighted(t, [] if own is None else own) for t, own in zip(texts, terms)], dtype=object)


def highlight(text: Column, terms: Column) -> Column:
    """The text with its own terms (an array of strings) marked."""
    return _highlight(text, terms.cast(ArrayType(StringType())))


def review_key(*parts: Column) -> Column:
    """SHA-256 over the parts; nulls count as empty."""
    return F.sha2(F.concat_ws(KEY_SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def label_of(text: Column) -> Column:
    """POS before NEG before NEU, anywhere in the text; null without one."""
    up = F.upper(text)
    return F.when(up.contains("POS"), "POS").when(up.contains("NEG"), "NEG").when(up.contains("NEU"), "NEU")


def label_line(line: Column) -> Column:
    """(index, label) of ``12: POS``, perhaps after ``Comment``; null unless there is exactly one colon and a number."""
    parts = F.split(line, ":")
    index = F.trim(F.regexp_replace(parts[0], r"(?i)comment", "")).try_cast("int")
    return F.when((F.size(parts) == 2) & index.isNotNull(), F.struct(index.alias("index"), label_of(parts[1]).alias("label")))


def is_unlabelled(label: Column) -> Column:
    return F.coalesce(F.trim(label).isin("", "<NEG/NEU/POS>"), F.lit(True))


def image_url(url: Column) -> Column:
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.when(full.rlike("^https?://"), full).otherwise("")


def looks_like_date(text: Column) -> Column:
    months = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    return F.coalesce(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") | text.rlike(rf"(?i)\b(?:{months})[a-z]*\b.*[0-9]{{4}}"), F.lit(False))


def stars(rating: Column) -> Column:
    return F.repeat(F.lit("★"), F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(rating.cast("int"), F.lit(0)))))


def listed(names: Column) -> Column:
    """``A``, ``A and B``, ``A, B, and C`` of an array, in order."""
    names = F.array_sort(names)
    n = F.size(names)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.element_at(names, 1))
        .when(n == 2, F.array_join(names, " and "))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, n - 1), ", "), F.lit(", and "), F.element_at(names, -1)))
    )


def iso_now() -> Column:
    """The time of the query in UTC, to the second; keep it out of results that are compared."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
