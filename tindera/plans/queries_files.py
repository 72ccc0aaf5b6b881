"""Queries over files: fixtures are written from the test tables, read, analysed, stored, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import reviews
from ..operators.store import Store
from ..operators.text_model import TextModel
from ..sources import products as S
from ..sources import sinks
from . import analyse
from .base import fixture_folder, query, table

BOM = b"\xef\xbb\xbf"


def _put(spark, name: str, pieces) -> str:
    path = f"{fixture_folder(spark)}/{name}"
    sinks.snapshot(spark, iter(pieces), path)
    return path


def _values(v: str, kind: str = "string", raw: str = "raw"):
    return F.try_variant_get(F.col(raw), f"$.{v}", kind)


@query("SELECT p_partkey::INT + (p_partkey >= 5)::INT AS ordinal, 'https://shopee.ph/product/1/' || p_partkey AS link, p_name AS name, p_size::VARCHAR AS rating, p_size * 3::BIGINT AS total_rating, 2 AS comments FROM part")
def json_product_scan(spark, sf_dir):
    """A list with a byte order mark and an element that is no object."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("https://shopee.ph/product/1/"), "p_partkey").alias("link"), F.col("p_name").alias("name"), F.col("p_size").alias("rating"), (F.col("p_size") * 3).alias("total_rating"), F.expr("array(named_struct('content', 'a'), named_struct('content', 'b'))").alias("comments"), "p_partkey")
    shown = F.to_json(F.struct(*[c for c in parts.columns if c != "p_partkey"]), {"ignoreNullFields": "false"})
    odd = spark.range(1).select(F.lit(4.5).alias("place"), F.lit("7").alias("j"))
    rows = parts.select(F.col("p_partkey").cast("double").alias("place"), shown.alias("j")).unionByName(odd)
    path = f"{fixture_folder(spark)}/shopee_ph_parts.json"
    sinks.write_json_array(rows.orderBy("place"), path, "j", before=BOM)
    found = S.typed_products(S.read_products(spark, path))
    return found.select("ordinal", "link", "name", "rating", "total_rating", F.size("comments").alias("comments"))


@query("SELECT s_suppkey::INT AS ordinal, s_name AS name, 'kept' AS note FROM supplier")
def json_wrapped_scan(spark, sf_dir):
    """An object with a ``products`` list; a file that is neither has none without ``strict``."""
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(F.col("s_name").alias("name"), F.lit("kept").alias("note"))
    path = _put(spark, "a.json", sinks.json_array(rows, before=b'{"when": "now", "products": ', after=b"}"))
    bad = _put(spark, "b.json", [b'{"products": 5}'])
    found = S.read_products(spark, path).unionByName(S.read_products(spark, bad, strict=False))
    return found.select("ordinal", _values("name").alias("name"), _values("note").alias("note"))


@query("SELECT conv_id::VARCHAR AS conv, turn::VARCHAR AS turn, role, coalesce(text, '') AS text FROM conversations")
def csv_review_scan(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    path = f"{fixture_folder(spark)}/talks.csv"
    sinks.write_csv(rows, path)
    return S.read_review_csv(spark, path)


@query("SELECT 'q' || quality AS actual, 'q' || toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL")
def evaluation_csv_scan(spark, sf_dir):
    """Known column names in any order; of several for one thing the first counts."""
    rows = table(spark, sf_dir, "labels").select(F.lit("x").alias("label"), F.concat(F.lit("q"), "toxic").alias("prediction"), F.concat(F.lit(" Q"), "quality").alias("true_label"))
    found = S.read_evaluation_csv(spark, _put(spark, "judged.csv", sinks.csv_export(rows)))
    return E.pair_counts(found, F.col("actual"), F.col("predicted"))


@query("SELECT * FROM (VALUES ('lazada_ph_b.json', 2::BIGINT), ('shopee_ph_a.json', 2::BIGINT), ('temu_ph_c.json', 4::BIGINT)) t(name, bytes)")
def result_file_listing(spark, sf_dir):
    folder = fixture_folder(spark)
    for name, content in {"shopee_ph_a.json": b"[]", "lazada_ph_b.json": b"[]", "temu_ph_c.json": b"[{}]", "temu_ph_c_analyzed.json": b"[]", "other.json": b"[]", "shopee_ph_a.csv": b"a"}.items():
        sinks.snapshot(spark, iter([content]), f"{folder}/{name}")
    return S.result_files(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes")


@query("SELECT r_name AS name, true AS warned, 'saved' AS source FROM region UNION ALL SELECT 'from upload', false, 'upload'")
def first_usable_file(spark, sf_dir):
    """The newest file is broken and is passed over with a warning; an upload comes before all files."""
    folder = fixture_folder(spark)
    rows = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    sinks.snapshot(spark, sinks.json_array(rows), f"{folder}/lazada_ph_good.json")
    for broken in ("temu_ph_broken.json", "shopee_ph_broken.json"):
        sinks.snapshot(spark, iter([b"{"]), f"{folder}/{broken}")
    found, warning = S.first_usable(spark, folder)
    upload, none = S.first_usable(spark, folder, uploaded=_put(spark, "u.json", [b'[{"name": "from upload"}]']))
    shown = lambda df, w, s: df.select(_values("name").alias("name"), F.lit(w is not None).alias("warned"), F.lit(s).alias("source"))
    return shown(found, warning, "saved").unionByName(shown(upload, none, "upload"))


@query("SELECT (CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey % 5 ELSE 0 END)::INT AS ordinal, 'l' || n_nationkey % 5 AS link, max(n_nationkey)::VARCHAR AS rating FROM nation GROUP BY ALL")
def resume_saved_products(spark, sf_dir):
    """Earlier output by link: the last of each at the place of its first; a broken file has none."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat(F.lit("l"), F.col("n_nationkey") % 5).alias("link"), F.col("n_nationkey").alias("rating"))
    path = _put(spark, "shopee_ph_x.json", sinks.json_array(rows))
    bad = S.resume_products(spark, _put(spark, "bad.json", [b"["]))
    return S.resume_products(spark, path).unionByName(bad).select("ordinal", "link", _values("rating").alias("rating"))


@query("SELECT 'shop' AS shop, 4::BIGINT AS first, 0::BIGINT AS second, false AS other_source, 9::BIGINT AS products")
def discovery_checkpoint(spark, sf_dir):
    """A discovery state is taken up only for the very source it was saved for; pages are at least 0."""
    path = f"{fixture_folder(spark)}/state.json"
    sinks.save_discovery_checkpoint(spark, path, {"kind": "shop"}, {"a": 4, "b": -3}, 9)
    state, other = S.read_discovery_checkpoint(spark, path, {"kind": "shop"}), S.read_discovery_checkpoint(spark, path, {"kind": "x"})
    return spark.createDataFrame([(state["source"]["kind"], state["completed_pages"]["a"], state["completed_pages"]["b"], other is not None, state["product_count"])], "shop string, first long, second long, other_source boolean, products long")


@query("SELECT * FROM (VALUES ('a.log', true, 7.8125::DOUBLE, 6000, 'end'), ('b.json', true, 0.0029296875::DOUBLE, 3, '{} ')) t(name, dated, kb, tail_chars, tail_end)")
def job_listing(spark, sf_dir):
    folder = fixture_folder(spark)
    sinks.snapshot(spark, iter([b"x" * 7997, b"end"]), f"{folder}/a.log")
    sinks.snapshot(spark, iter([b"{} "]), f"{folder}/b.json")
    rows = S.job_files(spark, folder)
    tails = spark.createDataFrame([(n, S.log_tail(spark, f"{folder}/{n}")) for n in ("a.log", "b.json")], "name string, tail string")
    return rows.join(tails, "name").select("name", F.col("modified").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$").alias("dated"), "kb", F.length("tail").alias("tail_chars"), F.right("tail", F.lit(3)).alias("tail_end"))


# Reviews by turn: negative and risky, positive, negative without risk, empty.
TALK = ("Basag at sayang", "Ayos!", "sablay!", "  ")


def _talks(spark, sf_dir) -> DataFrame:
    """Products out of conversations: reviews under any of the known fields, elements that are no reviews, fields nobody knows."""
    turn = F.col("turn")
    said = F.element_at(F.array(*[F.lit(x) for x in TALK]), (turn % 4 + 1).cast("int"))
    field = F.element_at(F.array(*[F.lit(x) for x in reviews.TEXT_FIELDS]), (turn % 4 + 1).cast("int"))
    one = F.concat(F.lit('{"'), field, F.lit('": "'), said, F.lit('", "mine": '), turn.cast("string"), F.lit("}"))
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    nested = talks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("j")))).alias("c"))
    comments = F.concat(F.lit('[null, "no review", '), F.array_join(F.transform("c", lambda x: x["j"]), ", "), F.lit("]"))
    return nested.select("conv_id", F.concat(F.lit('{"name": "c'), F.col("conv_id").cast("string"), F.lit('", "link": "same", "own": {"a": [1]}, "comments": '), comments, F.lit("}")).alias("j"))


_TALK_SQL = """
t AS (SELECT DISTINCT conv_id, turn, turn % 4 AS k FROM conversations),
d AS (SELECT *, k < 3 AND turn > min(turn) OVER (PARTITION BY conv_id, k) AS dup FROM t),
s AS (SELECT conv_id, count(*) + 2 AS elements, count(*) FILTER (k < 3 AND NOT dup) AS review_count, count(*) FILTER (dup) AS duplicates, count(*) FILTER (k = 1 AND NOT dup) AS positive,
  count(*) FILTER (k IN (0, 2) AND NOT dup) AS negative, count(*) FILTER (k IN (0, 2) AND NOT dup) AS risky FROM d GROUP BY conv_id)
"""


@query(
    f"""WITH {_TALK_SQL} SELECT 'c' || conv_id AS name, '[1]' AS own, elements, review_count, duplicates, positive, negative, risky,
      round_even(CASE WHEN review_count > 0 THEN 100 * (0.3::DOUBLE * (negative / review_count) + 0.7::DOUBLE * (risky / review_count)) ELSE 0 END, 2)::DOUBLE AS risk_score FROM s
    UNION ALL SELECT 'no comments', NULL, NULL, 0, 0, 0, 0, 0, 0.0 UNION ALL SELECT 'no list', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"""
)
def analysed_products(spark, sf_dir):
    """A whole analysis of a product file, which loses no product, no field and no review, whatever field its text is under."""
    extra = spark.createDataFrame([(1, '{"name": "no comments"}'), (2, '{"name": "no list", "comments": "x"}'), (3, "5")], "conv_id long, j string")
    rows = _talks(spark, sf_dir).withColumn("part", F.lit(0)).unionByName(extra.withColumn("part", F.lit(1))).orderBy("part", "conv_id")
    path = f"{fixture_folder(spark)}/shopee_ph_talks.json"
    sinks.write_json_array(rows, path, "j")
    out = analyse.analyse_file(spark, path, TextModel())
    found = S.read_products(spark, out)
    v = _values
    return found.select(
        v("name").alias("name"), v("own.a").alias("own"), F.when(F.size(v("comments", "array<variant>")) >= 0, F.size(v("comments", "array<variant>"))).cast("long").alias("elements"), v("sentiment_summary.review_count", "long").alias("review_count"),
        v("sentiment_summary.duplicate_review_count", "long").alias("duplicates"), v("sentiment_summary.sentiment_counts.positive", "long").alias("positive"), v("sentiment_summary.sentiment_counts.negative", "long").alias("negative"),
        v("sentiment_summary.risk_review_count", "long").alias("risky"), v("sentiment_summary.risk_score", "double").alias("risk_score"),
    )


@query(
    f"""WITH {_TALK_SQL} SELECT conv_id, turn, CASE WHEN dup THEN (min(turn) OVER (PARTITION BY conv_id, k) - (SELECT min(turn) FROM t x WHERE x.conv_id = d.conv_id) + 2)::INT END AS duplicate_of,
      dup AS is_duplicate, CASE k WHEN 1 THEN 'positive' WHEN 3 THEN 'neutral' ELSE 'negative' END AS label, CASE k WHEN 0 THEN 'defect' WHEN 2 THEN 'quality' ELSE '' END AS categories FROM d"""
)
def analysed_reviews(spark, sf_dir):
    """The same, a row per review; places count elements that are no reviews."""
    elements = _talks(spark, sf_dir).select(F.lit("talks").alias("path"), F.col("conv_id").alias("ordinal"), F.parse_json("j").alias("raw"))
    found = analyse.analyse_products(elements, TextModel()).select("ordinal", F.posexplode(F.try_variant_get(F.parse_json("json"), "$.comments", "array<variant>")).alias("pos", "raw")).where("pos > 1")
    v = _values
    return found.select(
        F.col("ordinal").alias("conv_id"), v("mine", "long").alias("turn"), v("duplicate_of", "int").alias("duplicate_of"), v("is_duplicate", "boolean").alias("is_duplicate"), v("sentiment_analysis.label").alias("label"),
        F.array_join(v("sentiment_analysis.risk.categories", "array<string>"), ",").alias("categories"),
    )


@query(
    """WITH r AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS row FROM nation), f AS (SELECT *, min(row) OVER (PARTITION BY k % 4) AS first FROM r)
    SELECT k::VARCHAR AS n, CASE k % 4 WHEN 1 THEN 'positive' WHEN 3 THEN 'neutral' ELSE 'negative' END AS sentiment_label, CASE WHEN k % 4 IN (0, 2) THEN 'True' ELSE 'False' END AS risk_detected,
      CASE k % 4 WHEN 0 THEN '1.0' WHEN 2 THEN '0.6667' ELSE '0.0' END AS risk_score, CASE k % 4 WHEN 0 THEN 'defect,safety' WHEN 2 THEN 'quality' ELSE '' END AS risk_categories,
      CASE k % 4 WHEN 1 THEN '[{"term": "ayos", "valence": 2.0, "language": "tl", "category": "general", "negated": false}]' WHEN 3 THEN '[]' END AS ayos,
      CASE k % 4 WHEN 2 THEN '[{"term": "sablay", "category": "quality", "severity": 2, "language": "tl", "negated": false}]' END AS sablay,
      CASE WHEN k % 4 < 3 AND row > first THEN 'True' ELSE 'False' END AS is_duplicate, CASE WHEN k % 4 < 3 AND row > first THEN first::VARCHAR ELSE '' END AS duplicate_of, 16 AS columns FROM f"""
)
def analysed_csv(spark, sf_dir):
    """A whole analysis of a review file: its columns, then thirteen more; duplicates are those of the whole file."""
    said = F.element_at(F.array(F.lit("Basag, umiinit"), F.lit("Ayos!"), F.lit("sablay!"), F.lit("  ")), (F.col("n_nationkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.col("n_nationkey").alias("n"), F.lit('x "y"\nz').alias("note"), said.alias("review"))
    out = analyse.analyse_file(spark, _put(spark, "reviews.csv", sinks.csv_export(rows)), TextModel())
    found = S.read_review_csv(spark, out)
    k = F.col("n").cast("int") % 4
    return found.select(
        "n", "sentiment_label", "risk_detected", "risk_score", "risk_categories", F.when(k.isin(1, 3), F.col("sentiment_evidence")).alias("ayos"), F.when(k == 2, F.col("risk_evidence")).alias("sablay"),
        "is_duplicate", "duplicate_of", F.lit(len(found.columns)).alias("columns"),
    )


@query("SELECT r_regionkey::VARCHAR AS id, r_name AS name, '' AS missing FROM region")
def csv_export_header(spark, sf_dir):
    """The header says what is written: other columns are left out, missing ones are empty."""
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.lit(9).alias("other"), F.col("r_name").alias("name"))
    return S.read_review_csv(spark, _put(spark, "r.csv", sinks.csv_export(rows, ["id", "name", "missing"])))


@query(
    """SELECT 'https://temu.com/' || s_suppkey AS link, CASE WHEN s_suppkey % 3 = 0 THEN 'Unnamed product' ELSE s_name END AS name, 'Temu PH' AS platform, '' AS category, 'second' AS source, s_suppkey::DOUBLE AS rating, 2::BIGINT AS review_count,
      CASE WHEN s_suppkey % 2 = 0 THEN 61.0 END::DOUBLE AS risk_score, CASE WHEN s_suppkey % 2 = 0 THEN 29.0 ELSE 100.0 END::DOUBLE AS reliability_score, 2::BIGINT AS reviews, 5 AS first_rating, CASE WHEN s_suppkey % 2 = 0 THEN 'negative' END AS sentiment, 2::BIGINT AS risky FROM supplier"""
)
def store_save_twice(spark, sf_dir):
    """Products saved twice under one link: rows are replaced, reviews keep their first rating and take the new analysis."""
    k = F.col("s_suppkey")

    def saved(rating: int, sentiment: str, detected: str):
        own = F.when(k % 2 == 0, F.lit(', "sentiment_summary": {"risk_score": 61.0, "sentiment_ratios": {"positive": 0.9}}')).otherwise(F.lit(""))
        label = F.when(k % 2 == 0, F.lit(f'"label": "{sentiment}", ')).otherwise(F.lit(""))
        review = lambda n: F.concat(F.lit(f'{{"author": "{n}", "content": "x", "rating": {rating}, "sentiment_analysis": {{'), label, F.lit(f'"risk": {{"detected": {detected}}}}}}}'))
        name = F.when(k % 3 > 0, F.concat(F.lit(', "name": "'), "s_name", F.lit('"'))).otherwise(F.lit(""))
        j = F.concat(F.lit('{"link": "  https://temu.com/'), k.cast("string"), F.lit(' "'), name, F.lit(', "rating": '), k.cast("string"), F.lit(', "comments": [3, '), review("a"), F.lit(", "), review("b"), F.lit("]"), own, F.lit("}"))
        blank = spark.createDataFrame([(0, '{"link": " ", "comments": []}')], "ordinal long, j string")
        return table(spark, sf_dir, "supplier").select(k.alias("ordinal"), j.alias("j")).unionByName(blank).select("ordinal", F.parse_json("j").alias("raw"))

    store = Store(spark, fixture_folder(spark))
    store.save_products(saved(5, "positive", "false"), "first")
    store.save_products(saved(1, "negative", "true"), "second")
    kept = store.read("reviews").groupBy("product_link").agg(F.count("*").alias("reviews"), F.max("rating").alias("first_rating"), F.max("sentiment").alias("sentiment"), F.sum("risk_detected").alias("risky"))
    return store.read("products").join(kept, F.col("link") == F.col("product_link")).select("link", "name", "platform", "category", "source", "rating", "review_count", "risk_score", "reliability_score", "reviews", "first_rating", "sentiment", "risky")


@query("SELECT * FROM (VALUES ('evaluation_runs', 2::BIGINT, 2::BIGINT), ('products', 0, NULL), ('reviews', 0, NULL), ('survey_responses', 3, 3)) t(name, n, last_id)")
def store_appends(spark, sf_dir):
    """Survey answers and evaluation runs get ids that go on; the counts are of all four tables."""
    store = Store(spark, fixture_folder(spark))
    form = spark.createDataFrame([(0, "t", "weekly", 90.0, 80.0, "{}"), (1, "u", "daily", 50.0, 40.0, "{}")], "ordinal int, submitted_at string, shopping_frequency string, sus_score double, umux_score double, responses_json string")
    store.append("survey_responses", form.where("ordinal = 0"))
    store.append("survey_responses", form)
    run = spark.createDataFrame([(0, "t", "x.csv", 3, 0.5, 0.5, 0.5, 0.5, "[]", "[]")], "ordinal int, run_at string, source_name string, sample_count long, accuracy double, precision double, recall double, f1 double, labels_json string, matrix_json string")
    store.append("evaluation_runs", run)
    store.append("evaluation_runs", run)
    last = store.read("survey_responses").agg(F.max("id").alias("last_id")).select(F.lit("survey_responses").alias("t"), "last_id").unionByName(store.read("evaluation_runs").agg(F.max("id").alias("last_id")).select(F.lit("evaluation_runs").alias("t"), "last_id"))
    return store.counts().join(last, F.col("table") == F.col("t"), "left").select(F.col("table").alias("name"), "n", "last_id")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'POS' END AS label, false AS in_backup FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def labels_put_back(spark, sf_dir):
    """Labels by coordinates put into a file's reviews; the original stays beside it."""
    rows = _talks(spark, sf_dir)
    numbered = rows.withColumn("outer_idx", F.row_number().over(_by("conv_id")) - 1)
    path = _put(spark, "talks.json", sinks.json_array(rows.orderBy("conv_id"), "j"))
    first = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    labels = first.withColumn("comment_idx", F.row_number().over(_by("turn", "conv_id")) + 1).where("turn % 2 = 0").join(numbered.select("conv_id", "outer_idx"), "conv_id").select("outer_idx", "comment_idx", F.lit("POS").alias("label"))
    kept = analyse.put_labels(spark, path, labels)

    def listed(p):
        each = S.read_products(spark, p).select(_values("name").alias("name"), F.posexplode(_values("comments", "array<variant>")).alias("pos", "raw")).where("pos > 1")
        return each.select(F.substring("name", 2, 30).cast("long").alias("conv_id"), _values("mine", "long").alias("turn"), _values("sentiment").alias("label"))

    old = listed(kept).select("conv_id", "turn", F.col("label").isNotNull().alias("in_backup"))
    return listed(path).join(old, ["conv_id", "turn"])


def _by(order: str, *keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(order) if keys else Window.orderBy(order)


@query("SELECT DISTINCT conv_id, true AS summarised, true AS kept_instance FROM conversations")
def analysis_cache(spark, sf_dir):
    """An unchanged file is not analysed again."""
    path = _put(spark, "shopee_ph_talks.json", sinks.json_array(_talks(spark, sf_dir).orderBy("conv_id"), "j"))
    cache = analyse.AnalysisCache(TextModel())
    once = cache.get(spark, path, 1)
    same = cache.get(spark, path, 1) is once
    found = once.select(F.parse_json("json").alias("raw"))
    return found.select(F.substring(_values("name"), 2, 30).cast("long").alias("conv_id"), _values("sentiment_summary", "variant").isNotNull().alias("summarised"), F.lit(same).alias("kept_instance"))


@query("SELECT c_custkey, 'x/' || CASE c_custkey % 3 WHEN 0 THEN 'shopee' WHEN 1 THEN 'lazada' ELSE 'temu' END || '_ph_lamp.json' AS path, 'x/lamp_analyzed.json' AS analysed, 'x/lamp_backup.json' AS backup FROM customer")
def output_paths(spark, sf_dir):
    paths = [sinks.output_path("x/", m, "lamp") for m in ("shopee", "lazada", "temu")]
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(p) for p in paths]), (F.col("c_custkey") % 3 + 1).cast("int")).alias("path"), F.lit(sinks.analysed_path("x/lamp.json")).alias("analysed"), F.lit(sinks.backup_path("x/lamp.json")).alias("backup"))


@query("SELECT n_nationkey, 'https://shopee.ph/a-i.1.' || n_nationkey AS link, n_nationkey % 2 = 1 AS blank FROM nation")
def seed_links(spark, sf_dir):
    """Blank products for links that were given directly; another site's link has none."""
    from ..sources import markets

    rows = table(spark, sf_dir, "nation")
    given = F.concat(F.lit("https://shopee.ph/a-i.1."), F.col("n_nationkey").cast("string"), F.lit("?x=1"))
    seeds = markets.product_from_link(given, "shopee")
    other = markets.product_from_link(F.lit("https://x.example/a"), "shopee")
    return rows.select("n_nationkey", seeds["link"].alias("link"), ((F.col("n_nationkey") % 2 == 1) & (seeds["name"] == "") & other.isNull()).alias("blank"))


@query("SELECT c_custkey, sha256('c' || chr(31) || chr(31) || chr(31) || c_name) AS review_key FROM customer")
def review_key_of_nulls(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.review_key(F.lit("c"), F.lit(None), F.lit(""), F.col("c_name")).alias("review_key"))
