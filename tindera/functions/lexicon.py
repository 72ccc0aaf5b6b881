"""Term lists: the shipped ones, and readers for others in tab-separated files."""

from __future__ import annotations

from importlib.resources import files
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .word_file import WordFile, ship


class SentimentTerm(NamedTuple):
    term: str
    valence: float
    language: str
    category: str


class RiskTerm(NamedTuple):
    term: str
    category: str
    severity: int
    language: str


def _shipped(kind: str, made: type) -> list:
    """The rows of a list in ``lexicons/``: blank lines and ``#`` lines don't count, terms are case-folded."""
    numbers = {SentimentTerm: (str, float, str, str), RiskTerm: (str, str, int, str)}[made]
    text = (files(__package__) / "lexicons" / f"{kind}.tsv").read_text(encoding="utf-8")
    rows = (line.split("\t") for line in text.split("\n") if line.strip() and not line.startswith("#"))
    return [made(*(f(x) for f, x in zip(numbers, (row[0].casefold(), *row[1:])))) for row in rows]


#: The shipped lists (109 and 71 terms, fixed values); other lists come from files by ``read_lexicon``.
SENTIMENT: list[SentimentTerm] = _shipped("sentiment", SentimentTerm)
RISK: list[RiskTerm] = _shipped("risk", RiskTerm)


def read_valences(spark: SparkSession, path: str, most: int = 100_000) -> dict[str, float]:
    """A public dictionary of word valences (token, mean, and columns that aren't used, separated by tabs), for ``TextModel``.

    It is configuration like a lexicon, so it comes to the driver; more than ``most`` words are an error: ``ship_valences`` takes such a dictionary.
    """
    rows = spark.read.option("sep", "\t").option("quote", "").schema("token string, valence double").csv(path).where("token is not null and valence is not null").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary of more than {most} words")
    return {r["token"]: r["valence"] for r in rows}


def ship_valences(spark: SparkSession, path: str) -> WordFile:
    """The same dictionary, of any size, as a file that workers map into memory."""
    return ship(spark.read.option("sep", "\t").option("quote", "").schema("token string, valence double").csv(path))


def lexicon_rows(spark: SparkSession, kind: str) -> DataFrame:
    """A shipped list as a table for display, with its columns' names."""
    rows, made = (SENTIMENT, SentimentTerm) if kind == "sentiment" else (RISK, RiskTerm)
    kinds = {"valence": "double", "severity": "int"}
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "line_no int, " + ", ".join(f"{f} {kinds.get(f, 'string')}" for f in made._fields))


def read_lexicon(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A term list from a tab-separated file without header; ``#`` begins a comment; terms in lower case; file order kept.

    ``kind``: ``sentiment`` (term, valence, language, category) or ``risk`` (term, category, severity, language).
    """
    columns = {"sentiment": "term string, valence double, language string, category string", "risk": "term string, category string, severity int, language string"}[kind]
    rows = spark.read.option("sep", "\t").option("comment", "#").option("quote", "").schema(columns).csv(path)
    return rows.where(F.col("term").isNotNull()).withColumn("term", F.lower("term")).withColumn("line_no", F.monotonically_increasing_id())


def terms_of(lexicon: DataFrame, kind: str, most: int = 100_000) -> list:
    """The rows of a lexicon for a model; a lexicon is configuration, and more than ``most`` terms are an error."""
    made = SentimentTerm if kind == "sentiment" else RiskTerm
    rows = lexicon.orderBy("line_no").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon of more than {most} terms")
    return [made(*(r[f] for f in made._fields)) for r in rows]
