"""The registered queries of the training-data operators: thin projections over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read_table
from .conversation_trie import trie_query
from .exact_dedup import exact_dedup
from .importance_resampling import importance_resample
from .importance_sql import ORACLE as IMPORTANCE_SQL
from .kneser_ney import lm_query
from .line_templates import line_query
from .packing import pack_documents
from .piece_nbest import piece_query
from .quality import quality_query
from .secret_scan import secret_query
from .simhash import simhash_query
from .spf_packing import pack_documents as spf_pack_documents
from .topk import top_k
from .url_filter import filter_urls


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_query(read_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op4_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_query(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_query(read_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_query(read_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_query(read_table(spark, sf_dir, "documents"), held_out("doc_id", 1))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_query(read_table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_spf_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spf_pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_piece_nbest": op4_piece_nbest,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_secret_scan": op7_secret_scan,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_lm_score": op9_lm_score,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_spf_packing": op13_spf_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH l AS (
  SELECT doc_id, text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
m AS (
  SELECT *, list_transform(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS toks FROM l),
leafed AS (SELECT *, len(toks) || ' ' || array_to_string(toks[1:3], ' ') AS leaf FROM m WHERE len(toks) > 0),
own AS (
  SELECT * FROM leafed WHERE leaf IN (SELECT leaf FROM leafed GROUP BY 1 HAVING count(DISTINCT text) >= 4)),
u AS (SELECT leaf, toks, count(DISTINCT text) AS docs FROM own GROUP BY ALL),
t AS (SELECT leaf, toks, docs, unnest(toks) AS tok, generate_subscripts(toks, 1) AS k FROM u),
s AS (SELECT leaf, k, tok, len(bin(CAST(sum(docs) AS BIGINT) // 4)) - 1 AS level FROM t WHERE tok <> '<*>' GROUP BY ALL HAVING sum(docs) >= 4),
p AS (SELECT t.leaf, t.toks, t.k, t.tok, s.level FROM t LEFT JOIN s ON t.leaf = s.leaf AND t.k = s.k AND t.tok = s.tok),
tp AS (
  SELECT p.leaf, p.toks, v.level, string_agg(CASE WHEN p.level >= v.level THEN p.tok ELSE '<*>' END, ' ' ORDER BY p.k) AS template
  FROM p JOIN (SELECT DISTINCT leaf, toks, level FROM p WHERE level IS NOT NULL) v ON p.leaf = v.leaf AND p.toks = v.toks
  GROUP BY ALL HAVING count(*) FILTER (WHERE p.level >= v.level) >= 0.5 * count(*)),
o AS (SELECT DISTINCT own.text, own.n, tp.leaf, tp.template FROM own JOIN tp ON own.leaf = tp.leaf AND own.toks = tp.toks),
r AS (SELECT leaf, template FROM o GROUP BY ALL HAVING count(DISTINCT text) >= 4),
lost AS (SELECT DISTINCT text, n FROM o JOIN r ON o.leaf = r.leaf AND o.template = r.template)
SELECT l.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(lost.n) AS INTEGER) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE lost.n IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN lost ON l.text IS NOT DISTINCT FROM lost.text AND l.n = lost.n GROUP BY l.doc_id, l.text""",
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t""",
    "op8_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_conversation_trie": r"""
WITH tbl AS (SELECT list(v ORDER BY b) AS tbl FROM (
  SELECT b, list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), b) AS v FROM range(256) r(b))),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, role, text, sha256(length(role) || ':' || role || text) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t),
o AS (SELECT conv_id, d, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, d) AS n FROM k),
c AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda s, x: xor(s >> 8, tbl[CAST(xor(s, x) % 256 + 1 AS INTEGER)]), CAST(4294967295 AS BIGINT))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o), tbl),
r AS (
  SELECT c.conv_id, 0 AS p, o.n, o.d, o.w FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.n <= c.h
  UNION ALL SELECT c.conv_id, 1, o.n, o.d, o.w FROM c JOIN o ON o.conv_id = c.conv_id AND o.n > c.h),
m AS (
  SELECT conv_id, row_number() OVER s AS depth, string_agg(d, '') OVER s AS key, w FROM r WINDOW s AS (PARTITION BY conv_id ORDER BY p, n ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
u AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w FROM m GROUP BY ALL),
e AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(key, depth) AS key FROM m GROUP BY 1) GROUP BY 1),
ch AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM u WHERE depth > 0 GROUP BY 1),
x AS (SELECT u.*, coalesce(ch.n, 0) AS n_children FROM u LEFT JOIN ch USING (key)),
a AS (SELECT left(key, 64 * unnest(range(depth + 1))) AS key, n_children, (n_convs - 1) * w AS saved FROM x),
s AS (SELECT key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM a GROUP BY 1)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM x JOIN s USING (key) LEFT JOIN e USING (key) LEFT JOIN u p ON x.depth > 0 AND p.key = left(x.key, 64 * (x.depth - 1))""",
    "op12_importance_resampling": IMPORTANCE_SQL,
}
