"""Classifier evaluation and survey scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N


def clean_label(label: Column) -> Column:
    return F.lower(F.trim(label))


def pair_counts(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """(actual, predicted, n): all that the measures need; a few rows, whatever the table's size."""
    return rows.groupBy(clean_label(actual).alias("actual"), clean_label(predicted).alias("predicted")).agg(F.count("*").alias("n"))


#: Labels of a matrix at most: it has a cell for each pair.
MOST_LABELS = 1000


def confusion_matrix(pairs: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """Counts for every pair of labels that occur on either side, zeros included; more than ``most`` labels are an error, as free texts are no labels."""
    labels = pairs.select(F.col("actual").alias("x")).union(pairs.select("predicted")).distinct().limit(most + 1)
    found = labels.agg(F.array_sort(F.collect_set("x")).alias("a"))
    few = F.when(F.size("a") <= most, F.col("a")).otherwise(F.raise_error(F.lit(f"more than {most} labels")).cast("array<string>"))
    every = found.select(few.alias("a")).select(F.explode("a").alias("actual"), F.col("a").alias("b")).select("actual", F.explode("b").alias("predicted"))
    return every.join(pairs, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def label_metrics(pairs: DataFrame) -> DataFrame:
    """Per label: precision, recall and f1, 0 where a denominator is 0."""
    sides = pairs.select(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).alias("called"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("right"))
    sides = sides.unionByName(pairs.select(F.col("predicted").alias("label"), F.lit(0).alias("support"), F.col("n").alias("called"), F.lit(0).alias("right")))
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "called", "right")])
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = over(F.col("right"), F.col("called")), over(F.col("right"), F.col("support"))
    return sums.select("label", "support", p.alias("precision"), r.alias("recall"), over(2 * p * r, p + r).alias("f1"))


def macro_metrics(pairs: DataFrame) -> DataFrame:
    """One row: sample count, accuracy, and plain means over all labels, to four digits.  No sample at all is an error."""
    totals = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sample_count"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    means = label_metrics(pairs).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
    n = F.when(F.col("sample_count") > 0, F.col("sample_count")).otherwise(F.raise_error(F.lit("no labels to evaluate")).cast("long"))
    rounded = lambda c, name: N.round_half_even(c, 4).alias(name)
    # Two rows of one: a global aggregate each.
    return totals.join(means, F.lit(True)).select(n.alias("sample_count"), rounded(F.col("right") / n, "accuracy"), *[rounded(F.col(c), c) for c in ("precision", "recall", "f1")])


def paired_labels(actual: Column, predicted: Column) -> Column:
    """Two arrays of labels as one of (actual, predicted); empty or of unequal length they are an error."""
    same = (F.size(actual) > 0) & (F.size(actual) == F.size(predicted))
    pairs = F.arrays_zip(actual.alias("actual"), predicted.alias("predicted"))
    return F.when(F.coalesce(same, F.lit(False)), pairs).otherwise(F.raise_error(F.lit("labels must be as many as predictions, and some")).cast("array<struct<actual:string,predicted:string>>"))


def rmse(rows: DataFrame, predicted: Column, expected: Column) -> DataFrame:
    return rows.agg(F.coalesce(F.sqrt(F.avg(F.pow(predicted - expected, F.lit(2)))), F.lit(0.0)).alias("rmse"))


def array_rmse(predicted: Column, expected: Column) -> Column:
    """Of two arrays, by place, cut to the shorter; 0 if one is empty."""
    n = F.least(F.size(predicted), F.size(expected))
    total = F.aggregate(F.zip_with(F.slice(predicted, 1, n), F.slice(expected, 1, n), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, F.sqrt(total / n)).otherwise(0.0)


def _checked(answers: Column, n: int, low: int, high: int, name: str, value: Column) -> Column:
    good = (F.size(answers) == n) & F.forall(answers, lambda x: x.between(low, high))
    return F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(F.lit(f"{name} needs {n} answers of {low} to {high}")).cast("double"))


def sus_score(answers: Column) -> Column:
    """0..100 of ten answers of 1 to 5; odd questions count up, even ones down.  Anything else is an error."""
    points = F.transform(answers, lambda x, i: F.when(i % 2 == 0, x - 1).otherwise(5 - x))
    return _checked(answers, 10, 1, 5, "SUS", F.aggregate(points, F.lit(0).cast("long"), lambda s, x: s + x) * 2.5)


def umux_score(answers: Column) -> Column:
    """0..100 of four answers of 1 to 7."""
    points = F.transform(answers, lambda x, i: F.when(i % 2 == 0, x - 1).otherwise(7 - x))
    return _checked(answers, 4, 1, 7, "UMUX", F.aggregate(points, F.lit(0).cast("long"), lambda s, x: s + x) / 24 * 100)
