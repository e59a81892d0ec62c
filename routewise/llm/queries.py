"""Registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_text, jaccard_join, langid, packing, pii, prefix_trie, quality_mil, spelling, topk, toxicity, vptree
from .common import id_crc, table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    scored = quality_mil.score(model, docs, ["doc_id"])
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= quality_mil.THRESHOLD).cast("int").alias("predicted"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), ["doc_id"])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract_pages(pages, html_text.fit_weights(pages), ["page_id", "url"])


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(id_crc() % 4 != 2))
    return langid.predict(model, docs, ["doc_id"]).select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = chat.turns_from_rows(rows.unionByName(chat.hostile_conversation(spark)))
    return chat.digest(chat.format_turns(turns))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op9_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), ["doc_id"], vocabulary_path())


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_crc() % 5 != 0)
    scored = toxicity.score(model, docs, ["doc_id"])
    return scored.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_jaccard_join, op3_pii, op4_packing, op5_html, op6_langid, op7_chat,
                                    op8_topk, op9_vptree, op10_bpe, op11_toxicity, op12_prefix_trie, op13_spelling)}


_OP2 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
x AS MATERIALIZED (SELECT r, unnest(sh) AS t FROM s),
sized AS MATERIALIZED (SELECT r, doc_id, len(sh) AS n FROM s),
hit AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM x a JOIN x b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM hit JOIN sized p ON p.r = a JOIN sized q ON q.r = b WHERE 100 * i >= 75 * (p.n + q.n - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM sized UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a)
SELECT p.doc_id, CAST(p.n AS BIGINT) AS n_shingles, min(q.doc_id) AS component_id
FROM reach JOIN sized p ON p.r = reach.a JOIN sized q ON q.r = reach.b GROUP BY p.r, p.doc_id, p.n
"""

_CONTROL = chat.CONTROL.replace("'", "''")
_OP7 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    -- ids, marks and line breaks around a turn: 12 + 1 + 10 + 1 characters; one more per backslash and control string
    length(role) + 2 * (length(role) - length(translate(role, '%<[' || chr(10), ''))) + 24 + length(text)
      + length(text) - length(replace(text, chr(92), ''))
      + len(regexp_extract_all(text, '{_CONTROL}')) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP8 = """
WITH good AS (
  SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM good),
s AS (SELECT a.place, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


# CRC-32 in SQL: the table of its polynomial, then one step per byte
_CRC_TABLE = """crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS tab FROM (
  SELECT b, list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) r(b)) z)"""
_CRC = "(4294967295 - list_reduce(list_prepend(4294967295, {bytes}), lambda a, x: xor(a // 256, tab[1 + xor(a % 256, x)])))"

_OP12 = f"""
WITH {_CRC_TABLE},
t AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS MATERIALIZED (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base,
    {_CRC.format(bytes="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))")} % 9 AS h FROM n, crc),
r AS (
  SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.n, 0)), t.role, t.text FROM c JOIN t USING (conv_id) LEFT JOIN n b ON b.conv_id = c.base WHERE t.pos >= c.h),
l AS (SELECT conv_id, list(md5(length(role) || ':' || role || text) ORDER BY pos) AS l, list(strlen(text) ORDER BY pos) AS bytes FROM r GROUP BY conv_id),
p AS (SELECT c.conv_id, coalesce(l, []) AS l, coalesce(bytes, []) AS bytes, unnest(generate_series(0, len(coalesce(l, [])))) AS d FROM c LEFT JOIN l USING (conv_id)),
k AS MATERIALIZED (
  SELECT conv_id, d, md5(array_to_string(l[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(l[1:d - 1], ',')) END AS up,
    CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS bytes, d = len(l) AS ends FROM p),
node AS MATERIALIZED (
  SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM k GROUP BY d, k),
child AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
linked AS MATERIALIZED (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child ON child.d = node.d AND child.k = node.k),
below AS (
  SELECT a.d, a.k, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum((x.n_convs - 1) * x.bytes) AS saved
  FROM linked x JOIN k a ON a.conv_id = x.conv_id AND a.d <= x.d GROUP BY a.d, a.k)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM linked x JOIN below ON below.d = x.d AND below.k = x.k LEFT JOIN node u ON u.d = x.d - 1 AND u.k = x.up
"""

# near words agree in one of the spellings with one letter left out: blanked (replaced) or cut (inserted, deleted)
_OP13 = f"""
WITH {_CRC_TABLE},
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (
  SELECT run, {_CRC.format(bytes="flatten(list_transform(string_split(id || ':' || run, ''), lambda z: CASE WHEN unicode(z) < 128 THEN [CAST(unicode(z) AS BIGINT)] ELSE [195, CAST(unicode(z) - 64 AS BIGINT)] END))")} AS h
  FROM run, crc WHERE length(run) >= 7),
v AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) z
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v) z),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word),
form AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * v.n THEN (SELECT min(near) FROM near x WHERE x.word = v.word AND x.near_n = most) END AS form
  FROM v LEFT JOIN best USING (word)),
lead AS (
  WITH RECURSIVE w AS (
    SELECT word, word AS root, form AS next, 0 AS step FROM form
    UNION ALL SELECT w.word, w.next, f.form, step + 1 FROM w JOIN form f ON f.word = w.next)
  SELECT word, arg_max(root, step) AS root FROM w GROUP BY word)
SELECT f.word, f.form, lead.root, f.n, f.n_near, g.n AS form_n FROM form f JOIN lead USING (word) LEFT JOIN v g ON g.word = f.form
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": _OP2, "op7_chat": _OP7, "op8_topk": _OP8, "op12_prefix_trie": _OP12, "op13_spelling": _OP13}
