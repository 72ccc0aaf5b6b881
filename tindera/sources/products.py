"""Readers for product and review files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reviews import last_of
from ..operators.schemas import PRODUCT
from . import json_lists

#: Bytes of a JSON file that one task reads whole at most; longer ones are read element by element, by many tasks.
WHOLE_BYTES = 16 << 20
ALIASES = {"actual": ("actual_label", "true_label", "label"), "predicted": ("predicted_label", "prediction"), "text": ("review_text", "text", "content")}


def read_elements(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All elements of the product lists of JSON files, objects or not: ``path``, ``ordinal`` (place in the list) and ``raw`` (variant).

    A file is a list, or an object with a ``products`` list (none at all is an empty one); a byte order mark is allowed.  Any other
    file is an error, or without ``strict`` has no products.
    """
    names = json_lists.long_files(spark, path, WHOLE_BYTES)
    texts = spark.read.text(path, wholetext=True)
    rows = _whole_elements(texts.where(F.col("_metadata.file_size") <= WHOLE_BYTES) if names else texts, strict)
    return rows.unionByName(_long_elements(spark, names, strict)) if names else rows


def _no_list(path: Column) -> Column:
    return F.raise_error(F.concat(F.lit("no list of products in "), path)).cast("variant")


def _long_elements(spark: SparkSession, names: dict[int, tuple[str, str]], strict: bool) -> DataFrame:
    found, bad = json_lists.listings(spark, names)
    if bad and strict:
        raise ValueError(f"no list of products in {bad[0]}")
    if not found:
        return spark.createDataFrame([], "path string, ordinal int, raw variant")
    rows = json_lists.elements(spark, found)
    if strict:
        return rows.withColumn("raw", F.when(F.col("raw").isNotNull(), F.col("raw")).otherwise(_no_list(F.col("path"))))
    return rows.join(rows.where(F.col("raw").isNull()).select("path").distinct(), "path", "left_anti")


def outer_fields(spark: SparkSession, path: str) -> dict | None:
    """The fields beside ``products`` of a file that is an object; null if it is a list."""
    names = json_lists.long_files(spark, path, WHOLE_BYTES)
    if names:
        found, bad = json_lists.listings(spark, names)
        if bad:
            raise ValueError(f"no list of products in {bad[0]}")
        return json_lists.outer_fields(spark, found)
    value = F.regexp_replace("value", "^\ufeff", "")
    fields = F.map_filter(F.from_json(value, "map<string,variant>"), lambda k, v: k != "products")
    rows = spark.read.text(path, wholetext=True).select(F.when(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.to_json(F.transform_values(fields, lambda k, v: F.to_json(v)))).alias("w")).limit(1).collect()
    return None if not rows or rows[0]["w"] is None else {k: json.loads(v) for k, v in json.loads(rows[0]["w"]).items()}


def _whole_elements(texts: DataFrame, strict: bool) -> DataFrame:
    files = texts.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(v)
    wrapped = F.coalesce(F.try_variant_get(v, "$.products", "variant"), F.parse_json(F.lit("[]")))
    rows = files.select("path", F.when(kind.startswith("OBJECT"), wrapped).otherwise(v).alias("v"))
    good = F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False))
    if strict:
        rows = rows.withColumn("v", F.when(good, F.col("v")).otherwise(_no_list(F.col("path"))))
    else:
        rows = rows.where(good)
    return rows.select("path", F.posexplode(F.col("v").cast("array<variant>")).alias("ordinal", "raw"))


def read_products(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The elements of ``read_elements`` that are objects."""
    return read_elements(spark, path, strict).where(F.schema_of_variant("raw").startswith("OBJECT"))


def field(name: str, kind: str = "string", raw: str = "raw") -> Column:
    """A field of a variant, or null if it is missing or of another kind."""
    return F.try_variant_get(F.col(raw), f"$.{name}", kind)


def typed_products(products: DataFrame) -> DataFrame:
    """The known fields with their types, whatever types a connector gave them; the rest stays in ``raw``."""
    names = [(f.name, f.dataType.simpleString()) for f in products.sparkSession.createDataFrame([], PRODUCT).schema]
    return products.select("ordinal", *[field(n, t).alias(n) for n, t in names], "raw")


def resume_products(spark: SparkSession, path: str) -> DataFrame:
    """Earlier output by link, the last of each at the place of the first; a bad file has none."""
    products = read_products(spark, path, strict=False).withColumn("link", field("link"))
    return last_of(products.where(F.coalesce(F.col("link"), F.lit("")) != ""), "link")


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of reviews: header, all columns text (empty ones too), quoted line breaks; an empty file is an error."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    if not rows.columns or rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows.na.fill("")


def read_evaluation_csv(spark: SparkSession, path: str) -> DataFrame:
    """``actual``, and ``predicted`` or ``text``, from the first of several known column names."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return evaluation_columns(rows)


def evaluation_columns(rows: DataFrame) -> DataFrame:
    found = {k: next((c for c in names if c in rows.columns), None) for k, names in ALIASES.items()}
    if found["actual"] is None or (found["predicted"] is None and found["text"] is None):
        raise ValueError("needs a column of actual labels and one of predictions or texts")
    return rows.select(*[F.col(c).alias(k) for k, c in found.items() if c is not None])


# What result files are called.
RESULTS = ("shopee_ph_*.json", "lazada_ph_*.json", "temu_ph_*.json")


def result_files(spark: SparkSession, folder: str, globs: tuple[str, ...] = RESULTS) -> DataFrame:
    """(path, modified, bytes) of result files in a folder, newest first, without analysed ones; no content is read."""
    pattern = globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    found = found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return found.where(~F.col("path").rlike(r"_analyzed\.[A-Za-z]+$")).orderBy(F.desc("modified"), "path")


def first_usable(spark: SparkSession, folder: str, uploaded: str | None = None, **options) -> tuple[DataFrame | None, str | None]:
    """The products of the upload, else of the newest file that has any; and the first failure met on the way."""
    if uploaded is not None:
        return read_products(spark, uploaded), None
    warning = None
    for row in result_files(spark, folder, **options).toLocalIterator():
        try:
            products = read_products(spark, row["path"])
            if not products.isEmpty():
                return products, warning
        except Exception as error:  # noqa: BLE001  a bad file is reported and passed over
            warning = warning or f"{row['path']}: {str(error).splitlines()[0]}"
    return None, warning


def read_discovery_checkpoint(spark: SparkSession, path: str, source: dict) -> dict | None:
    """The saved discovery state, if it was made for this very source; page numbers are at least 0."""
    lines = spark.read.text(path, wholetext=True).limit(1).collect()
    try:
        state = json.loads(lines[0]["value"]) if lines else None
    except ValueError:
        return None
    if not isinstance(state, dict) or state.get("source") != source:
        return None
    pages = state.get("completed_pages") or {}
    return state | {"completed_pages": {k: max(0, int(v)) for k, v in pages.items()}}


def job_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, modified, kb) of job files."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.date_format("modificationTime", "yyyy-MM-dd HH:mm").alias("modified"), (F.col("length") / 1024).alias("kb"))


def log_tail(spark: SparkSession, path: str, chars: int = 6000) -> str:
    rows = spark.read.text(path, wholetext=True).select(F.right("value", F.lit(chars)).alias("tail")).collect()
    return rows[0]["tail"] if rows else ""


def seed_products(spark: SparkSession, links: list[str], platform: str) -> DataFrame:
    """Blank products for links that were given directly."""
    return spark.createDataFrame([(i, link, platform) for i, link in enumerate(links)], "ordinal int, link string, platform string")
