"""Queries of the text model on sentences whose scores follow from the published rules.

The SQL has each sentence's word valences, as the rules make them one by one, and does the sums anew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators.reviews import mark_duplicates
from ..operators.text_model import TextModel
from ..sources.sinks import snapshot
from .base import fixture_folder, query, table

# (text, words' valences after negation, boosters and contrast, push of the punctuation, severity, categories, sentiment terms, negated ones, risk terms, negated ones)
SENTENCES = (
    ("Ayos ang tela, legit ang tahi", "2.0, 0, 0, 2.3, 0, 0", 0, 0, "", 2, 0, 0, 0),
    ("Hindi ayos ang kulay", "0, 2.0 * -0.74, 0, 0", 0, 0, "", 1, 1, 0, 0),
    ("Sobrang ganda talaga", "0, 2.5 + 0.293, 0", 0, 0, "", 1, 0, 0, 0),
    ("Basag ang salamin pero ayos ang kahon", "-3.1 * 0.5, 0, 0, 0, 2.0 * 1.5, 0, 0", 0, 3, "defect", 2, 0, 1, 0),
    ("Walang basag, walang gasgas!", "0, -3.1 * -0.74, 0, -1.8 * -0.74 * -0.74", 0.292, 0, "", 2, 2, 2, 2),
    ("Walang sira at swabe ang motor", "2.2, 0, 2.2, 0, 0", 0, 0, "", 2, 0, 1, 1),
    ("Umiinit ang charger; delikado sa bata", "-2.0, 0, 0, -3.2, 0, 0", 0, 3, "safety", 2, 0, 2, 0),
    ("Kulang ang turnilyo", "-2.2, 0, 0", 0, 2, "defect", 1, 0, 1, 0),
    ("Maluwag ang takip", "-1.8, 0, 0", 0, 1, "defect", 1, 0, 1, 0),
    ("Bumili ako ng isa pa", "0, 0, 0, 0, 0", 0, 0, "", 0, 0, 0, 0),
    ("👍👍 salamat", "2.5, 2.5, 0", 0, 0, "", 2, 0, 0, 0),
    ("Not original at mukhang peke", "-3.3, 0, -3.3", 0, 3, "counterfeit", 2, 0, 2, 0),
    ("Medyo mabagal???", "0, -1.9 + 0.293", 0.54, 2, "performance", 1, 0, 1, 0),
    ("Ｓｉｒａ kahapon", "-3.1, 0", 0, 3, "defect", 1, 0, 1, 0),
    ("wlang tunog", "-2.5", 0, 2, "performance", 1, 0, 1, 0),
    ("Kaso nasira agad, sayang pera", "0, -3.4, -3.1", 0, 3, "durability", 2, 0, 1, 0),
    ("Hindi naman sirain pero hindi sulit", "0, 0, -2.9 * -0.74 * 0.5, 0, -2.7 * 1.5", 0, 0, "", 2, 1, 1, 1),
    ("Bukas naging mabagal at palpak, umiinit din", "0, 0, -1.9, 0, -3.0, -2.0, 0", 0, 2, "performance,quality,safety", 3, 0, 3, 0),
)


def _scores(rows: str, keys: str) -> str:
    """SQL that sums word valences (a list ``v``, and a push ``p``) up to shares and a compound."""
    return f"""
    t AS (SELECT *, list_sum(v) AS s, list_sum(list_transform(list_filter(v, lambda x: x > 0), lambda x: x + 1)) AS up, -list_sum(list_transform(list_filter(v, lambda x: x < 0), lambda x: x - 1)) AS down, len(list_filter(v, lambda x: x = 0)) AS flat FROM {rows}),
    u AS (SELECT *, coalesce(up, 0) + CASE WHEN coalesce(up, 0) > coalesce(down, 0) THEN p ELSE 0 END AS a, coalesce(down, 0) + CASE WHEN coalesce(up, 0) < coalesce(down, 0) THEN p ELSE 0 END AS b, s + sign(s) * p AS z FROM t),
    w AS (SELECT {keys}, round(b / (a + b + flat), 3)::DOUBLE AS neg, round(flat / (a + b + flat), 3)::DOUBLE AS neu, round(a / (a + b + flat), 3)::DOUBLE AS positive, round(z / sqrt(z * z + 15), 4)::DOUBLE AS compound FROM u)"""


def _rows() -> str:
    return ", ".join(f"({k}, [{v}]::DOUBLE[], {p}::DOUBLE, {severity}, '{categories}', {st}, {sn}, {rt}, {rn})" for k, (_, v, p, severity, categories, st, sn, rt, rn) in enumerate(SENTENCES))


@query(
    f"""WITH r(k, v, p, severity, categories, terms, negated_terms, risks, negated_risks) AS (VALUES {_rows()}), {_scores("r", "k, severity, categories, terms, negated_terms, risks, negated_risks")}
    SELECT p_partkey, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label, neg, neu, positive, compound, severity > 0 AS detected, round(severity / 3, 4)::DOUBLE AS score,
      categories, terms, negated_terms, risks, negated_risks FROM part JOIN w ON k = p_partkey % {len(SENTENCES)}"""
)
def model_sentences(spark, sf_dir):
    """The whole model with the shipped lists: negation, contrast, boosters, phrases, emoji, spellings, full-width letters."""
    text = F.element_at(F.array(*[F.lit(s[0]) for s in SENTENCES]), (F.col("p_partkey") % len(SENTENCES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", TextModel().analyse(text).alias("a"))
    count = lambda path: F.size(F.col(f"a.{path}"))
    negated = lambda path: F.size(F.filter(F.col(f"a.{path}"), lambda e: e["negated"]))
    a = lambda path: F.col(f"a.{path}")
    return rows.select(
        "p_partkey", a("label").alias("label"), a("scores.neg").alias("neg"), a("scores.neu").alias("neu"), a("scores.pos").alias("positive"), a("scores.compound").alias("compound"), a("risk.detected").alias("detected"),
        a("risk.score").alias("score"), F.array_join(a("risk.categories"), ",").alias("categories"), count("sentiment_evidence").alias("terms"), negated("sentiment_evidence").alias("negated_terms"),
        count("risk.evidence").alias("risks"), negated("risk.evidence").alias("negated_risks"),
    )


# Words of the public dictionary and their valences, as a fixture.
WORDS = {"good": 1.9, "bad": -2.5, "great": 3.1, "nice": 1.8, "hate": -2.7, "love": 3.2}
# (text, valences, push, evidence as term:negated)
DICTIONARY_SENTENCES = (
    ("a good lamp", "1.9, 0", 0, "good:false"),
    ("Not GOOD", "0, 1.9 * -0.74", 0, "good:true"),
    ("very good!!", "0, 1.9 + 0.293", 0.584, "good:false"),
    ("(good)", "0", 0, "good:false"),
    ("good!!!!", "0", 1.168, "good:false"),
    ("never so bad", "0, 0, (-2.5 - 0.293) * 1.5", 0, "bad:true"),
    ("this bad lamp", "0, -2.5, 0", 0, "bad:false"),
    ("it was this bad", "0, 0, 0, -2.5 * 1.25", 0, "bad:false"),
    ("kind of nice", "0, 0, 1.8", 0, "nice:false"),
    ("the least nice", "0, 0, 1.8 * -0.74", 0, "nice:false"),
    ("at least nice", "0, 0, 1.8", 0, "nice:false"),
    ("good, but I hate the box", "1.9 * 0.5, 0, -2.7 * 1.5, 0, 0", 0, "good:false,hate:false"),
    ("isn't that really great?", "0, 0, 0, (3.1 + 0.293) * -0.74", 0, "great:true"),
    ("we love love it", "0, 3.2, 3.2, 0", 0, "love:false,love:false"),
    ("ayos at good", "2.0, 0, 1.9", 0, "ayos:false,good:false"),
)


def _dictionary_rows() -> str:
    return ", ".join(f"({k}, [{v}]::DOUBLE[], {p}::DOUBLE, '{e}')" for k, (_, v, p, e) in enumerate(DICTIONARY_SENTENCES))


@query(
    f"""WITH r(k, v, p, evidence) AS (VALUES {_dictionary_rows()}), {_scores("r", "k, evidence")}
    SELECT s_suppkey, neg, neu, positive, compound, evidence FROM supplier JOIN w ON k = s_suppkey % {len(DICTIONARY_SENTENCES)}"""
)
def dictionary_words(spark, sf_dir):
    """Words of a dictionary that is read from a path; its tokens, negators, boosters and marks."""
    path = f"{fixture_folder(spark)}/valences.txt"
    snapshot(spark, iter([f"{w}\t{v}\t0.5\t[1]\n".encode() for w, v in WORDS.items()]), path)
    model = TextModel(dictionary=lexicon.read_valences(spark, path))
    text = F.element_at(F.array(*[F.lit(s[0]) for s in DICTIONARY_SENTENCES]), (F.col("s_suppkey") % len(DICTIONARY_SENTENCES) + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", model.analyse(text).alias("a"))
    shown = F.array_join(F.transform("a.sentiment_evidence", lambda e: F.concat_ws(":", e["term"], e["negated"].cast("string"))), ",")
    return rows.select("s_suppkey", *[F.col(f"a.scores.{c}").alias({"pos": "positive"}.get(c, c)) for c in ("neg", "neu", "pos", "compound")], shown.alias("evidence"))


@query("SELECT * FROM (VALUES ('counterfeit', 10::BIGINT, 29::BIGINT), ('defect', 12, 24), ('durability', 7, 19), ('performance', 20, 49), ('quality', 8, 16), ('safety', 14, 41)) t(category, terms, severities)")
def lexicon_browse(spark, sf_dir):
    """The shipped risk list by category."""
    rows = lexicon.lexicon_rows(spark, "risk")
    return rows.groupBy("category").agg(F.count("*").alias("terms"), F.sum("severity").alias("severities"))


@query("SELECT 'brand' || lpad(split_part(p_brand, '#', 2), 2, '0') || ' ß' AS term, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def lexicon_scan(spark, sf_dir):
    """A term list written as a tab-separated file with comments and blank lines, read again; terms are in lower case."""
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("BRAND"), F.lpad(F.split_part("p_brand", F.lit("#"), F.lit(2)), 2, "0"), F.lit(" ß")).alias("term"))
    counts = names.groupBy("term").agg(F.count("*").alias("n"))
    path = f"{fixture_folder(spark)}/risk.tsv"
    lines = (f"{r['term']}\tdefect\t{r['n'] % 3 + 1}\ten\n\n".encode() for r in counts.toLocalIterator())
    snapshot(spark, iter([b"# term, category, severity, language\n", *lines]), path)
    rows = lexicon.read_lexicon(spark, path, "risk")
    return counts.withColumn("term", F.lower("term")).join(rows.where("severity between 1 and 3 and category = 'defect'").select("term"), "term").select("term", "n")


@query("SELECT doc_id AS pos, 0 AS form, false AS is_duplicate, NULL::BIGINT AS duplicate_of FROM (SELECT doc_id, text FROM documents WHERE doc_id % 10 = 3 AND length(text) > 0) UNION ALL SELECT doc_id, 1, regexp_matches(text, '[\\p{L}\\p{N}]'), CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}]') THEN doc_id * 2 END FROM documents WHERE doc_id % 10 = 3 AND length(text) > 0")
def fingerprint_forms(spark, sf_dir):
    """Full-width capitals and other punctuation make no other fingerprint: each text of a fixture beside such a form of itself."""
    wide = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF10 + i) for i in range(10))
    docs = table(spark, sf_dir, "documents").where("doc_id % 10 = 3 AND length(text) > 0")
    other = F.concat(F.lit("¡"), F.translate(F.translate(F.col("text"), "abcdefghijklmnopqrstuvwxyz0123456789", wide), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", wide[:26]), F.lit(" …"))
    both = docs.select("doc_id", F.lit(0).alias("form"), "text").unionByName(docs.select("doc_id", F.lit(1).alias("form"), other.alias("text")))
    rows = both.withColumn("place", F.col("doc_id") * 2 + F.col("form"))
    marked = mark_duplicates(rows, T.fingerprint_key(F.col("text")), ("doc_id",), "place")
    return marked.select(F.col("doc_id").alias("pos"), "form", "is_duplicate", "duplicate_of")


@query("SELECT c_custkey, lower(c_name) || ' it''s hindi ok' AS plain, lower(replace(c_name, '#', ' ')) || ' it s hindi ok' AS print FROM customer")
def text_normalise(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.upper("c_name"), F.lit("  IT’S hndi  ｏｋ "))
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalise(raw).alias("plain"), T.fingerprint(raw).alias("print"))
