"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, fim, minhash, ngram_lm, packing, pii, prefix_trie, sharding, token_counts, toxicity, url_filter, warc
from .shared import bound_batches, scratch_path, table

#: Where the tokenizer's file is; a parameter, never copied into the repository.
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024

#: The tree of 8 shards.
SHARDS = sharding.layout(regions=2, racks=2, shards=2)

#: Rules of the URL filter.
RULES: list[url_filter.Rule] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score(table(spark, sf_dir, "documents"), stable=True)
    return scored.withColumn("log_score", F.round("log_score", 5))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), payload="packed_ids", numbered=True)
    return packing.pack(pieces, open_as="ids_crc32", numbered=("task", "place"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % ann.QUERY_EVERY == 0))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder, payload=False).drop("url")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARDS)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.rearrange(table(spark, sf_dir, "documents"))
    output, form = F.col("output"), F.col("form")
    digests = {"output_sha256": F.sha2(output.cast("binary"), 256), "restored_sha256": F.sha2(fim.restored(output, form).cast("binary"), 256)}
    return made.withColumns(digests).drop("output")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def _bounded(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _bounded(f) for f in (op1_lm_scoring, op2_url_filter, op3_best_fit_packing, op4_minhash_near_dedup, op5_decontamination, op6_nearest_neighbours, op7_pii, op8_warc, op9_toxicity, op10_token_counts, op11_sharding, op12_fill_in_middle, op13_prefix_trie)
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_AT = "strpos({0}, '://')"
_REST = "substr({0}, strpos({0}, '://') + 3)"
_HOST = "CASE WHEN strpos({0}, '://') > 0 THEN translate(regexp_extract(" + _REST + ", '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
_PATH = "CASE WHEN strpos({0}, '://') > 0 THEN regexp_extract(" + _REST + ", '^[^/?#]*([^?#]*)', 1, 's') ELSE '' END"
_NODE = "CASE WHEN strpos({0}, '://') > 0 THEN (" + _HOST + ") || CASE WHEN regexp_extract(" + _REST + ", '^[^/?#]*([^#]*)', 1, 's') = '' THEN '/' ELSE regexp_extract(" + _REST + ", '^[^/?#]*([^#]*)', 1, 's') END END"

#: Absolute links only: the tables hold no others.
OP2_SQL = f"""
WITH RECURSIVE rules(h, p, v) AS (VALUES {_RULE_ROWS}),
found AS (
  SELECT url AS source, unnest(list_concat(
    regexp_extract_all(html, '<link\\b[^<>]*\\brel\\s*=\\s*(?:"[^"<>]*\\bcanonical\\b|''[^''<>]*\\bcanonical\\b|canonical\\b)[^<>]*\\bhref\\s*=\\s*["'']?([^"''\\s<>]+)', 1, 'is'),
    regexp_extract_all(html, '<link\\b[^<>]*\\bhref\\s*=\\s*["'']?([^"''\\s<>]+)["'']?[^<>]*\\brel\\s*=\\s*(?:"[^"<>]*\\bcanonical\\b|''[^''<>]*\\bcanonical\\b|canonical\\b)', 1, 'is'),
    regexp_extract_all(html, '<meta\\b[^<>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^<>]*\\bcontent\\s*=\\s*["'']?[^"''<>]*url\\s*=\\s*([^"''\\s<>]+)', 1, 'is'))) AS target
  FROM pages WHERE url IS NOT NULL),
links AS (SELECT source, target FROM found WHERE strpos(target, '://') > 0),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION SELECT target FROM links) WHERE url IS NOT NULL),
parts AS (SELECT url, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path, {_NODE.format("url")} AS node FROM urls),
fitting AS (
  SELECT url, h || p AS rule, v, row_number() OVER (PARTITION BY url ORDER BY length(h) + length(p) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
ruled AS (SELECT p.*, f.rule, f.v FROM parts p LEFT JOIN fitting f ON f.url = p.url AND f.k = 1),
steps AS (
  SELECT a.node AS x, b.node AS y FROM links JOIN parts a ON a.url = source JOIN parts b ON b.url = target
  UNION SELECT b.node, a.node FROM links JOIN parts a ON a.url = source JOIN parts b ON b.url = target),
reach(x, y) AS (SELECT x, x FROM steps UNION SELECT r.x, s.y FROM reach r JOIN steps s ON s.x = r.y),
tainted AS (SELECT DISTINCT x AS node FROM reach JOIN ruled ON ruled.node = y WHERE v = 'block')
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  coalesce(v, CASE WHEN t.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN v IS NOT NULL THEN 'rule' WHEN t.node IS NOT NULL THEN 'alias' ELSE 'default' END AS by
FROM pages LEFT JOIN ruled ON ruled.url = pages.url LEFT JOIN tainted t ON t.node = ruled.node
"""

OP1_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS w, len(w) AS n FROM d),
pair AS (SELECT doc_id, p, n, w, lag(w) OVER o AS before, lag(w, 2) OVER o AS early FROM pos WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
one AS (SELECT w, count(*) AS c FROM pos GROUP BY w),
own1 AS (SELECT doc_id, w, count(*) AS c FROM pos GROUP BY ALL),
two AS (SELECT before, w, count(*) AS c FROM pair WHERE before IS NOT NULL GROUP BY ALL),
own2 AS (SELECT doc_id, before, w, count(*) AS c FROM pair WHERE before IS NOT NULL GROUP BY ALL),
three AS (SELECT early, before, w, count(*) AS c FROM pair WHERE early IS NOT NULL GROUP BY ALL),
own3 AS (SELECT doc_id, early, before, w, count(*) AS c FROM pair WHERE early IS NOT NULL GROUP BY ALL),
total AS (SELECT count(*) AS c FROM pos),
term AS (
  SELECT pair.doc_id, p, three.c - own3.c AS seen3, bef2.c - obef2.c AS base3, two.c - own2.c AS seen, bef.c - obef.c AS base, one.c - own1.c AS single, greatest(total.c - n, 1) AS rest
  FROM pair JOIN one ON one.w = pair.w JOIN own1 ON own1.doc_id = pair.doc_id AND own1.w = pair.w CROSS JOIN total
  LEFT JOIN three ON three.early = pair.early AND three.before = pair.before AND three.w = pair.w
  LEFT JOIN own3 ON own3.doc_id = pair.doc_id AND own3.early = pair.early AND own3.before = pair.before AND own3.w = pair.w
  LEFT JOIN two bef2 ON bef2.before = pair.early AND bef2.w = pair.before
  LEFT JOIN own2 obef2 ON obef2.doc_id = pair.doc_id AND obef2.before = pair.early AND obef2.w = pair.before
  LEFT JOIN two ON two.before = pair.before AND two.w = pair.w
  LEFT JOIN own2 ON own2.doc_id = pair.doc_id AND own2.before = pair.before AND own2.w = pair.w
  LEFT JOIN one bef ON bef.w = pair.before LEFT JOIN own1 obef ON obef.doc_id = pair.doc_id AND obef.w = pair.before),
summed AS (
  SELECT doc_id, count(*) FILTER ((p = 2 AND seen = 0) OR (p > 2 AND seen3 = 0)) AS n_backoff,
    sum(CASE WHEN p > 2 AND seen3 > 0 THEN ln(seen3) - ln(base3)
      ELSE CASE WHEN p > 2 THEN ln({ngram_lm.ALPHA}) ELSE 0 END + CASE WHEN p > 1 AND seen > 0 THEN ln(seen) - ln(base)
        ELSE ln(greatest(single, {ngram_lm.UNSEEN}) / rest) + CASE WHEN p > 1 THEN ln({ngram_lm.ALPHA}) ELSE 0 END END END) AS s
  FROM term GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(coalesce(s, 0), 5)::DOUBLE AS log_score
FROM d LEFT JOIN summed USING (doc_id)
"""

#: Windows as lists of words, joined to the lists at every position of the documents.
OP5_SQL = """
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM low),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS k, least(13, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT pos.doc_id, pos.p, pos.n, win.item_id FROM pos JOIN win ON win.k = pos.k AND win.n = pos.n),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
lead AS (SELECT h, max(page_id) AS leader FROM p GROUP BY h),
five AS (SELECT page_id, k, ('0x' || substr(s, 5 * k + 1, 5))::BIGINT AS v FROM p, range(8) r(k)),
code AS (SELECT page_id, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INT + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INT + 1, 1), '' ORDER BY k) AS d
  FROM five GROUP BY page_id)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM p JOIN lead USING (h) JOIN code USING (page_id)
"""

#: CRC-32 of a text's UTF-8 bytes, given its table as ``tab`` of the relation ``crc``.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, v: xor(c >> 8, tab[(xor(c, v) & 255) + 1])), 4294967295)"


def _tree_rows(tree: list[sharding.Leaf], name: str) -> list[str]:
    rows = [(name, level, parent, child, weight) for level, of in enumerate(sharding._children(tree)) for parent, children in of.items() for child, weight in children.items()]
    return [f"('{n}', {k}, '{p}', '{c}', {w}::DOUBLE)" for n, k, p, c, w in rows]


_DRAWN = "(SELECT child FROM tree WHERE tree = '{tree}' AND level = {level} AND parent = {parent} ORDER BY -ln((('0x' || substr(md5(key || ':' || child), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight, child LIMIT 1)"


def _shard_sql(tree: str) -> list[str]:
    """Columns of the three levels that a key descends, each by a lookup among the children of the one before."""
    at, out = "''", []
    for level in range(3):
        out.append(_DRAWN.format(tree=tree, level=level, parent=at) + f" AS {tree}{level}")
        at = f"{tree}{level}"
    return out


_OLD, _NEW = _shard_sql("old"), _shard_sql("new")
OP11_SQL = f"""
WITH {_CRC_TABLE},
tree(tree, level, parent, child, weight) AS (VALUES {", ".join(_tree_rows(SHARDS, "old") + _tree_rows(sharding.grown(SHARDS), "new"))}),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, strlen(coalesce(text, '')) + 1 AS size, {_CRC.format("coalesce(text, '')")} AS text_crc32 FROM documents, crc),
l0 AS (SELECT *, {_OLD[0]}, {_NEW[0]} FROM d),
l1 AS (SELECT *, {_OLD[1]}, {_NEW[1]} FROM l0),
l2 AS (SELECT *, {_OLD[2]}, {_NEW[2]} FROM l1)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, old2::INT AS shard,
  row_number() OVER (PARTITION BY old2 ORDER BY md5(key || '/' || size || '/' || text_crc32), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, new2::INT AS grown_shard
FROM l2
"""

_UNITS = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS u, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, len(u) AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= {fim.RATE} THEN 'plain' WHEN r[4] % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM e),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256
FROM p
"""

#: Turns are named by exact rank; a node's key is the list of its turns.
OP13_SQL = f"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
kinds AS (SELECT role, text, row_number() OVER (ORDER BY role, text) AS k, strlen(text) AS bytes FROM (SELECT DISTINCT role, text FROM t)),
own AS (SELECT conv_id, list(k ORDER BY turn NULLS FIRST, md5(role || chr(31) || text)) AS w FROM t JOIN kinds USING (role, text) GROUP BY conv_id),
cut AS (SELECT own.*, {_CRC.format("conv_id::VARCHAR")} % {prefix_trie.DEPTHS} AS h FROM own, crc),
full_ AS (SELECT cut.conv_id, list_concat(coalesce(b.w[1:h], []), coalesce(cut.w[h + 1:], [])) AS w FROM cut LEFT JOIN own b ON b.conv_id = cut.conv_id - cut.conv_id % {prefix_trie.GROUP}),
path AS (SELECT conv_id, d, len(w) AS n, array_to_string(w[1:d], ',') AS k, array_to_string(w[1:d - 1], ',') AS pk, w[d] AS last FROM (SELECT conv_id, w, unnest(range(len(w) + 1)) AS d FROM full_)),
node AS (SELECT d, path.k AS k, any_value(pk) AS pk, min(path.conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(bytes), 0) AS bytes, count(*) FILTER (n = d) AS n_ends,
    sha256(coalesce(string_agg(path.conv_id::VARCHAR, ',' ORDER BY path.conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM path LEFT JOIN kinds ON kinds.k = path.last GROUP BY d, path.k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
below AS (SELECT path.d, path.k, count(*) FILTER (n_convs = n_ends) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM node JOIN path ON path.conv_id = node.conv_id AND path.d <= node.d GROUP BY ALL)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens, node.ends_sha256
FROM node JOIN below ON below.d = node.d AND below.k = node.k LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k LEFT JOIN node up ON up.d = node.d - 1 AND up.k = node.pk
"""

ORACLES: dict[str, str] = {"op1_lm_scoring": OP1_SQL, "op2_url_filter": OP2_SQL, "op5_decontamination": OP5_SQL, "op8_warc": OP8_SQL, "op11_sharding": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_prefix_trie": OP13_SQL}
