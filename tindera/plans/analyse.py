"""Whole analyses: a file of products, or of reviews, from reading to the written result."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import fingerprint_key
from ..operators import reviews, summary
from ..operators.text_model import TextModel
from ..scratch import bound_batches, free, written
from ..sources import products as sources
from ..sources import sinks

KEYS = ("path", "ordinal")


def _text(review: Column) -> Column:
    """The first field for texts that a review has, even if it is empty; zero and false are no text."""
    found = F.lit("")
    for name in reversed(reviews.TEXT_FIELDS):
        value = F.try_variant_get(review, f"$.{name}", "variant")
        kind = F.schema_of_variant(value)
        shown = F.when(kind == "BOOLEAN", F.when(value.cast("boolean"), "True")).when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.when(value.cast("double") != 0, value.cast("string"))).otherwise(F.try_variant_get(value, "$", "string"))
        found = F.when(value.isNotNull(), F.coalesce(shown, F.lit(""))).otherwise(found)
    return found


def product_reviews(products: DataFrame) -> DataFrame:
    """(path, ordinal, pos, content): every review of products (``path``, ``ordinal``, ``raw``) that is an object."""
    listed = F.try_variant_get(F.col("raw"), "$.comments", "variant")
    is_list = F.schema_of_variant("raw").startswith("OBJECT") & F.coalesce(F.schema_of_variant(listed).startswith("ARRAY"), F.lit(False))
    rows = products.where(is_list).select(*KEYS, F.posexplode(listed.cast("array<variant>")).alias("pos", "r"))
    return rows.where(F.coalesce(F.schema_of_variant("r").startswith("OBJECT"), F.lit(False))).select(*KEYS, "pos", _text(F.col("r")).alias("content"))


@F.pandas_udf(StringType())
def _merged(raw: pd.Series, rows: pd.Series, summaries: pd.Series) -> pd.Series:
    """Products' JSON with what was found put into it: analyses at their reviews' places, and the summary."""

    def one(text: str, found, summed: str | None) -> str:
        product = json.loads(text)
        for r in [] if found is None else found:
            product["comments"][r["pos"]] |= {
                "sentiment_analysis": json.loads(r["analysis"]), "is_duplicate": bool(r["is_duplicate"]), "duplicate_of": None if pd.isna(r["duplicate_of"]) else int(r["duplicate_of"]),
            }
        if summed is not None:
            product["sentiment_summary"] = json.loads(summed)
        return json.dumps(product, ensure_ascii=False)

    return pd.Series([one(*x) for x in zip(raw, rows, summaries)], dtype=object)


def analyse_products(products: DataFrame, model: TextModel) -> DataFrame:
    """Products (``path``, ``ordinal``, unique together, and ``raw``) with their reviews analysed and a summary each, as ``json``.

    Every element comes out, and every field of it: elements that aren't objects and products whose ``comments`` are no list are left
    as they are, those without ``comments`` get a summary of zeros.  Scoring comes before any shuffle; what goes
    back to a product's row is its own reviews' analyses, which stand in that row anyway.
    """
    bound_batches(products.sparkSession)
    found = product_reviews(products).withColumn("a", model.analyse(F.col("content")))
    found = found.select(
        *KEYS, "pos", "a", F.col("a.label").alias("label"), F.col("a.scores.compound").alias("compound"), F.col("a.risk.detected").alias("detected"), F.col("a.risk.categories").alias("categories"), fingerprint_key(F.col("content")).alias("fingerprint"),
    )
    # Written once: the marks, the summary, its categories and the products' own rows all read it, and no text is scored again.
    marked = reviews.mark_duplicates(written(found), F.col("fingerprint"), KEYS)
    summed = summary.summarise(marked, keys=KEYS).join(summary.category_map(summary.category_counts(marked, KEYS), KEYS), list(KEYS), "left")
    entry = F.struct("pos", F.to_json("a", {"ignoreNullFields": "false"}).alias("analysis"), "is_duplicate", "duplicate_of")
    arrays = marked.groupBy(*KEYS).agg(F.collect_list(entry).alias("rows"))
    joined = products.join(arrays, list(KEYS), "left").join(summed, list(KEYS), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    real = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    labels = ("positive", "neutral", "negative")
    nested = F.struct(
        zero("review_count").alias("review_count"), F.struct(*[zero(x).alias(x) for x in labels]).alias("sentiment_counts"), F.struct(*[real(f"{x}_ratio").alias(x) for x in labels]).alias("sentiment_ratios"),
        real("average_compound").alias("average_compound"), zero("risk_review_count").alias("risk_review_count"), real("keyword_failure_rate").alias("keyword_failure_rate"), real("risk_score").alias("risk_score"),
        F.coalesce("risk_categories", F.create_map().cast("map<string,bigint>")).alias("risk_categories"), zero("duplicate_review_count").alias("duplicate_review_count"),
    )
    comments = F.try_variant_get(F.col("raw"), "$.comments", "variant")
    counted = F.schema_of_variant("raw").startswith("OBJECT") & (comments.isNull() | F.coalesce(F.schema_of_variant(comments).startswith("ARRAY"), F.lit(False)))
    return joined.select(*KEYS, _merged(F.to_json("raw"), F.col("rows"), F.when(counted, F.to_json(nested))).alias("json"))


@F.pandas_udf(StringType())
def _json_text(rows: pd.Series) -> pd.Series:
    plain = lambda v: v.item() if hasattr(v, "item") else v
    return pd.Series([json.dumps([{k: plain(v) for k, v in dict(e).items()} for e in r], ensure_ascii=False) for r in rows], dtype=object)


#: The columns that ``analyse_csv`` adds, in order.
ADDED = (
    "sentiment_label", "sentiment_positive", "sentiment_neutral", "sentiment_negative", "sentiment_compound", "risk_detected", "risk_score", "risk_categories",
    "sentiment_evidence", "risk_evidence", "is_duplicate", "duplicate_of", "model_version",
)


def analyse_csv(rows: DataFrame, model: TextModel, text_column: str | None = None, place: str = "row_no") -> DataFrame:
    """The rows of a review file (with ``place``, their number from 0) and 13 columns more; duplicates are those of the whole file."""
    text = reviews.review_text(rows.columns, text_column)
    own, found, key = (free(x, rows.columns) for x in ("text", "analysis", "fingerprint"))
    scored = rows.withColumn(own, text).withColumn(found, model.analyse(F.col(own)))
    marked = reviews.mark_duplicates(scored, fingerprint_key(F.col(own)), group=(), place=place, name=key)
    a = lambda path: F.col(f"{found}.{path}")
    made = (
        a("label"), a("scores.pos"), a("scores.neu"), a("scores.neg"), a("scores.compound"), a("risk.detected"), a("risk.score"), F.array_join(a("risk.categories"), ","),
        _json_text(a("sentiment_evidence")), _json_text(a("risk.evidence")), F.col("is_duplicate"), F.coalesce(F.col("duplicate_of").cast("string"), F.lit("")), a("model_version"),
    )
    return marked.select(*[c for c in rows.columns if c not in ADDED], *[c.alias(n) for n, c in zip(ADDED, made)])


def numbered(rows: DataFrame, place: str = "row_no") -> DataFrame:
    """Rows with their number from 0 in the order of the file: a count per partition, and the rows before it.

    Rows are written with their partition and their place in it, so that both are the same however the table is read later.
    """
    at, part = free("at", rows.columns, [place]), free("part", rows.columns, [place])
    marked = rows.withColumn(at, F.monotonically_increasing_id())
    parted = written(marked.withColumn(part, F.shiftright(at, 33)))
    return reviews.running_index(parted, part, at, place).drop(part, at)


def analyse_file(spark: SparkSession, path: str, model: TextModel, target: str | None = None, text_column: str | None = None, one_file: bool = True) -> str:
    """Analyse a JSON file of products or a CSV of reviews and write the result beside it; returns its path.

    The result is one file of the input's form, written by tasks and whole or not
    at all; without ``one_file`` a folder, written by all tasks.
    """
    kind = path.rpartition(".")[2].lower()
    if kind not in ("json", "csv"):
        raise ValueError("the input must be a .json or .csv file")
    target = target or sinks.analysed_path(path)
    sinks.refuse_same(path, target)
    if kind == "csv":
        given = sources.read_review_csv(spark, path)
        place = free("row_no", given.columns, list(ADDED))
        rows = analyse_csv(numbered(given, place), model, text_column, place)
        if not one_file:
            return sinks.write_analysed(rows.drop(place), path, target, "csv")
        ordered = rows.orderBy(place).drop(place)
        flags = [n for n, t in ordered.dtypes if t == "boolean"]
        sinks.write_csv(ordered.withColumns({n: F.initcap(F.col(n).cast("string")) for n in flags}), target)
        return target
    found = analyse_products(sources.read_elements(spark, path), model)
    if not one_file:
        return sinks.write_analysed(found.select(F.parse_json("json").alias("product")), path, target, "json")
    sinks.write_json_array(found.orderBy("ordinal"), target, "json", *_around(spark, path))
    return target


def _around(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    """What stands before and after the list of products in a file's own form: an object keeps its other fields."""
    fields = sources.outer_fields(spark, path)
    if fields is None:
        return b"", b""
    rest = json.dumps(fields, ensure_ascii=False, indent=2)[:-1].rstrip() if fields else "{"
    return (rest + ("," if fields else "") + '\n"products": ').encode(), b"\n}"


def typed(found: DataFrame) -> DataFrame:
    """The products of ``analyse_products`` with their known fields typed, and ``raw``."""
    rows = found.select("ordinal", F.parse_json("json").alias("raw"))
    return sources.typed_products(rows)


class AnalysisCache:
    """Analyses by file and time of its last change: an unchanged file is not analysed again.

    A file all of whose products have a summary is taken as it is.
    """

    def __init__(self, model: TextModel) -> None:
        self.model, self._known = model, {}

    def get(self, spark: SparkSession, path: str, modified) -> DataFrame:
        key = (path, modified)
        if key not in self._known:
            for old in [k for k in self._known if k[0] == path]:
                self._known.pop(old).unpersist()
            products = sources.read_products(spark, path)
            done = not summary.needs_analysis(products.select(F.try_variant_get(F.col("raw"), "$.sentiment_summary", "variant").alias("sentiment_summary")))
            self._known[key] = (products.select(*KEYS, F.to_json("raw").alias("json")) if done else analyse_products(products, self.model)).cache()
        return self._known[key]


def save_back(spark: SparkSession, path: str, model: TextModel) -> None:
    """Put the analysis of a result file in the file's own place and form; the old content stays until the new is whole."""
    found = analyse_products(sources.read_elements(spark, path), model)
    sinks.write_json_array(found.orderBy("ordinal"), path, "json", *_around(spark, path))


def put_labels(spark: SparkSession, path: str, labels: DataFrame, field: str = "sentiment") -> str:
    """Labels (``outer_idx``, ``comment_idx``, ``label``) put into a file's reviews; the original is kept beside it, and its path returned."""
    products = sources.read_elements(spark, path)
    kept = sinks.backup_path(path)
    sinks.refuse_same(path, kept)
    sinks.write_json_array(products.orderBy("ordinal").select(F.to_json("raw").alias("json")), kept, "json")
    by_product = labels.groupBy(F.col("outer_idx").alias("ordinal")).agg(F.collect_list(F.struct("comment_idx", "label")).alias("given"))

    def put(raw: pd.Series, given: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(raw, given):
            product = json.loads(text)
            for r in [] if found is None else found:
                product["comments"][r["comment_idx"]][field] = r["label"]
            out.append(json.dumps(product, ensure_ascii=False))
        return pd.Series(out, dtype=object)

    labelled = sources.read_elements(spark, kept).join(by_product, "ordinal", "left").select("ordinal", F.pandas_udf(put, StringType())(F.to_json("raw"), F.col("given")).alias("json"))
    sinks.write_json_array(labelled.orderBy("ordinal"), path, "json")
    return kept


def main(arguments: Sequence[str] | None = None) -> int:
    """``python -m tindera.plans.analyse INPUT [-o OUTPUT] [--text-column NAME]`` or ``--text TEXT``."""
    import argparse

    parser = argparse.ArgumentParser(description="Analyse reviews of a JSON file of products or a CSV")
    parser.add_argument("input", nargs="?")
    parser.add_argument("-o", "--output")
    parser.add_argument("--text-column")
    parser.add_argument("--text")
    parser.add_argument("--dictionary", help="a public file of word valences")
    asked = parser.parse_args(arguments)
    if asked.text is None and asked.input is None:
        parser.error("an input file or --text is needed")
    spark = SparkSession.builder.getOrCreate() if asked.text is None or asked.dictionary else None
    from ..functions.lexicon import read_valences

    model = TextModel(dictionary=read_valences(spark, asked.dictionary) if asked.dictionary else None)
    if asked.text is not None:
        print(json.dumps(model.analysis(asked.text), ensure_ascii=False, indent=2))
        return 0
    try:
        print(f"Analysis saved to {analyse_file(spark, asked.input, model, asked.output, asked.text_column)}")
    except ValueError as error:
        parser.exit(1, f"Error: {error}\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
