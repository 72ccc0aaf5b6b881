"""Analyses by what was analysed: a table by digest of the text and version of the model, to which only unseen texts are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import free
from . import bloom
from .text_model import ANALYSIS, TextModel


class Analyses:
    """Analyses below a folder, a sub-folder for each version of the model.

    A text that occurs in many reviews, files and runs is scored once for a version; another version scores all again beside it.
    Writers only add files, so two that meet may score a text twice, and a reader takes one of the two equal rows.
    """

    def __init__(self, spark: SparkSession, folder: str, model: TextModel) -> None:
        self.spark, self.model = spark, model
        self.path = f"{folder.rstrip('/')}/version={model.version}"

    def known(self) -> DataFrame:
        """``digest`` and ``analysis`` of all texts that were scored under this version."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        there = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        rows = self.spark.read.schema(f"digest binary, analysis {ANALYSIS.simpleString()}").parquet(self.path) if there else self.spark.createDataFrame([], f"digest binary, analysis {ANALYSIS.simpleString()}")
        return rows.dropDuplicates(["digest"])

    @staticmethod
    def digest(text: Column) -> Column:
        return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))

    def add(self, texts: DataFrame, text: str) -> int:
        """Score the texts that aren't known yet; how many that were.

        Texts meet by digest before the shuffle, and a Bloom filter of their digests thins the known ones before theirs.
        """
        once = texts.groupBy(self.digest(F.col(text)).alias("digest")).agg(F.any_value(F.coalesce(text, F.lit(""))).alias("text"))
        thinned = bloom.within(self.known().select("digest"), "digest", once)
        unseen = once.join(thinned, "digest", "left_anti")
        before = self.known().count()
        unseen.select("digest", self.model.analyse(F.col("text")).alias("analysis")).write.mode("append").parquet(self.path)
        return self.known().count() - before

    def attach(self, rows: DataFrame, text: str, name: str = "analysis") -> DataFrame:
        """Rows with the analysis of their text, null where it isn't known; all columns stay."""
        key = free("digest", rows.columns, [name])
        known = self.known().select(F.col("digest").alias(key), F.col("analysis").alias(name))
        return rows.withColumn(key, self.digest(F.col(text))).join(known, key, "left").drop(key)
