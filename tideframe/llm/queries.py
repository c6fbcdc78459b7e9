"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.llm import decontaminate, language, licenses, lm, minhash, mixing, packing, sharding, suffixes, toxicity, tries, vectors, whitening
from tideframe.llm.graph import keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op2_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), length=200).drop("spans")


def op4_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op5_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op6_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(runs, 0L, (s, r) -> s + r.end - r.first)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM b)),
dw AS (SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT d.r, d.w, ks.k, unnest(range(1, len(d.w) - ks.k + 2)) AS s FROM d, (SELECT DISTINCT k FROM b) ks WHERE len(d.w) >= ks.k)),
h AS (SELECT dw.r, dw.s, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""


def op8_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TELLS = [(t, own) for t, own in enumerate(licenses.telling_places(licenses.BASE, licenses.TEMPLATES)) if own]

OP8_SQL = f"""
WITH tells(t, places) AS (VALUES {", ".join(str(x) for x in _TELLS)}),
tpl(t, pairs, is_base, label, q, a, b) AS (VALUES {_values(licenses.template_rows(licenses.BASE, licenses.TEMPLATES))}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT r, w, unnest(range(1, len(w))) AS p FROM d),
v AS (SELECT r, t, pairs, is_base, label, p - 1 - q AS diagonal, list(DISTINCT q) AS held FROM x JOIN tpl ON w[p] = a AND w[p + 1] = b GROUP BY ALL),
s AS (SELECT r, t, is_base, label, (is_base AND len(held) = pairs)::INT AS n_base, CASE WHEN is_base AND len(held) = pairs THEN diagonal END AS place,
        CASE WHEN is_base THEN (len(held) = pairs)::INT ELSE len(seen) / pairs END AS share,
        CASE WHEN is_base THEN len(held) = pairs ELSE len(seen) / pairs >= {licenses.SHARE} AND len(list_filter(coalesce(places, []), lambda x: NOT list_has_any(x, seen))) = 0 END AS holds
      FROM (SELECT *, list_distinct(flatten(list(held) OVER (PARTITION BY r, t ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {licenses.DRIFT} FOLLOWING))) AS seen FROM v) LEFT JOIN tells USING (t)),
f AS (SELECT r, sum(n_base)::BIGINT AS n_base, min(place)::BIGINT AS first_word, max(place)::BIGINT AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n_base > 0) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds) AS labels, max(share)::DOUBLE AS score
      FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (r)
"""


def op9_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=5, percent=85)


# Slices of blobs are bytes; the bytes kept are put together as hexadecimal text, two characters a byte.
OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, encode(coalesce(text, '')) AS bytes FROM documents),
w AS (SELECT r, p, hash(array_slice(bytes, p + 1, p + 200)) AS h FROM (SELECT r, x, bytes, unnest(range(0, (length(x) // 2 - 199)::BIGINT)) AS p FROM d)),
dup AS (SELECT r, p FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, p, sum(far) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM
      (SELECT r, p, coalesce((p - lag(p) OVER (PARTITION BY r ORDER BY p) > 200)::INT, 1) AS far FROM dup)),
s AS (SELECT r, span, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY r, span),
e AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM s),
k AS (SELECT e.r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, count(*) AS n, sum(b - a)::BIGINT AS gone FROM e JOIN d USING (r) GROUP BY e.r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

_REACH = """
r(id, c) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
"""

OP9_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings),
{_REACH}
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN m ON m.id = vec_id
"""

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
nodes AS (SELECT DISTINCT doc_id AS id FROM documents),
{_REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id
"""


def op11_polarisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the file of a public tokenizer that is installed on the driver
    from public_tokenizers import path

    return packing.pack(_table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """The turns of conversations rebuilt on the beginning of another: conv_id, place, digest, size.

    Conversation c begins with the first h turns of c - c % 5, or all of them if
    there are fewer, and goes on with its own behind its first h; h is
    crc32(c) % 9. All that is looked up by conversation has at most eight rows of one.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % 9).alias("h")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.least("n", F.lit(8)).alias("most"))
    convs = lengths.select("conv_id", h, (c - c % 5).alias("base")).join(bases, "base", "left")
    given = convs.select("conv_id", "base", "h", F.least("h", F.coalesce("most", F.lit(0))).alias("given"))
    heads = turns.filter((F.col("place") < 8) & (c % 5 == 0)).withColumnRenamed("conv_id", "base")
    first = given.join(heads, "base").filter("place < given").select("conv_id", "place", "digest", "size")
    own = turns.join(given, "conv_id").filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "digest", "size")
    return first.unionByName(own)


def op13_prefix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = keep(tries.ordered(_table(spark, sf_dir, "conversations")))
    return tries.trie(with_shared_heads(turns), turns.select("conv_id").distinct())


# crc32 bit by bit, over the digits of a number
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda held, x: list_reduce(list_concat([xor(held, x)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, _: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

OP13_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n, {_CRC32} % 9 AS h FROM t GROUP BY conv_id),
c AS (SELECT x.conv_id, x.h, x.conv_id - x.conv_id % 5 AS base, least(x.h, coalesce(y.n, 0)) AS given FROM n x LEFT JOIN n y ON y.conv_id = x.conv_id - x.conv_id % 5),
r AS (SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.base AND p < given UNION ALL SELECT conv_id, p - h + given, role, text FROM t JOIN c USING (conv_id) WHERE p >= h),
s AS (SELECT conv_id, p + 1 AS d, strlen(text) AS bytes, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY p) AS path FROM r UNION ALL SELECT conv_id, 0, 0, [] FROM c),
v AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saves FROM s GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
b AS (SELECT path[1:u] AS path, sum(saves) AS saved, sum(leaf) AS leaves FROM (SELECT v.path, saves, (n_children IS NULL)::INT AS leaf, unnest(range(0, d + 1)) AS u FROM v LEFT JOIN k USING (path)) GROUP BY 1),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(path, d) AS path FROM s GROUP BY conv_id) GROUP BY path)
SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v LEFT JOIN k USING (path) LEFT JOIN b USING (path) LEFT JOIN e USING (path) LEFT JOIN v o ON v.d > 0 AND o.path = v.path[1:v.d - 1]
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_backoff": op1_backoff,
    "op2_raking": op2_raking,
    "op3_suffix_array": op3_suffix_array,
    "op4_crf": op4_crf,
    "op5_pseudo_likelihood": op5_pseudo_likelihood,
    "op6_hypergeometric": op6_hypergeometric,
    "op7_winnowing": op7_winnowing,
    "op8_diagonals": op8_diagonals,
    "op9_flat_graph": op9_flat_graph,
    "op10_minhash": op10_minhash,
    "op11_polarisation": op11_polarisation,
    "op12_best_two_fit": op12_best_two_fit,
    "op13_prefix_blocks": op13_prefix_blocks,
}

ORACLES: dict[str, str] = {
    "op3_suffix_array": OP3_SQL,
    "op9_flat_graph": OP9_SQL,
    "op10_minhash": OP10_SQL,
    "op7_winnowing": OP7_SQL,
    "op8_diagonals": OP8_SQL,
    "op13_prefix_blocks": OP13_SQL,
}
