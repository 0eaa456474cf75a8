"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, jaccard, languages, licenses, paragraphs, periodic, piece_counts, quotes, repeats, simhash, templates, tries


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.matches_by_query(audio.sonify(_table(spark, sf_dir, "embeddings")))


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.duplicate_paragraphs(_table(spark, sf_dir, "documents"))


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(quotes.as_mail(_table(spark, sf_dir, "conversations")))


def op5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return languages.identify(docs, languages.fit(docs))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(_table(spark, sf_dir, "documents")))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(periodic.repeat_tails(_table(spark, sf_dir, "documents"))))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(tries.rebuilt(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_chroma, op3_paragraphs, op4_quotes, op5_templates, op6_bpe, op7_languages, op8_token_counts, op9_licenses, op10_repeats, op11_jaccard, op12_runs, op13_trie)}

#: The answer to ``op4_quotes`` from the turns alone: its mail quotes the message before and that one's quotation.
_QUOTES_SQL = """
WITH t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2),
l AS (SELECT conv_id, turn, text IS NOT NULL AS said, coalesce(regexp_matches(lag(text) OVER w, '[\\p{L}\\p{N}]'), false) AS one, coalesce(regexp_matches(lag(text, 2) OVER w, '[\\p{L}\\p{N}]'), false) AS two, lag(turn) OVER w AS prev, lag(turn, 2) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q AS (SELECT conv_id, turn, CASE WHEN said THEN one::BIGINT + two::BIGINT ELSE 0 END AS n, CASE WHEN said AND two AND NOT one THEN before ELSE prev END AS reply_to FROM l),
h AS (SELECT *, max(turn) FILTER (n = 0) OVER (PARTITION BY conv_id ORDER BY turn) AS thread FROM q)
SELECT c.conv_id, c.turn, c.role, trim(c.text) AS own_text, reply_to, NULL::BIGINT AS quoted_conv, n AS n_quotes, n AS n_linked, thread,
  row_number() OVER (PARTITION BY c.conv_id ORDER BY thread, c.turn, trim(c.text) NULLS FIRST, c.role NULLS FIRST) AS position
FROM conversations c JOIN h ON c.conv_id = h.conv_id AND c.turn = h.turn
"""

#: The answer to ``op11_jaccard``: all pairs with a common shingle are counted, and links followed until nothing is new.
_JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.a, r.m FROM r JOIN e ON e.b = r.d)
SELECT d AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY 1
"""

#: The answer to ``op13_trie`` from prefixes of digests: each node is a distinct prefix, and gives its saving to all above it.
_CRC = "xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda crc, byte: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, byte)), 4294967295), 4294967295)"
_TRIE_SQL = f"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id AS c, {_CRC} % 9 AS h FROM (SELECT DISTINCT conv_id FROM raw)),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k, md5(length(role) || ':' || role || text) AS d, strlen(text) AS b FROM raw),
q AS (SELECT c, 0 AS part, k, d, b FROM ids JOIN n ON n.conv_id = c - c % 5 WHERE k < h UNION ALL SELECT c, 1, k, d, b FROM ids JOIN n ON n.conv_id = c WHERE k >= h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, k) AS depth, d, b FROM q),
p AS (SELECT c, depth, b, string_agg(d, '') OVER (PARTITION BY c ORDER BY depth) AS path FROM s UNION ALL SELECT c, 0, 0, '' FROM ids),
node AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(b) AS own FROM p GROUP BY ALL),
kid AS (SELECT path[:length(path) - 32] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
ends AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT * FROM p QUALIFY depth = max(depth) OVER (PARTITION BY c)) GROUP BY 1),
below AS (SELECT p.path, sum(v.own) AS saved, count(*) FILTER (k.path IS NULL) AS leaves FROM node v JOIN p ON p.c = v.conv_id AND p.depth <= v.depth LEFT JOIN kid k ON k.path = v.path GROUP BY 1)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node v LEFT JOIN node u ON v.depth > 0 AND u.path = v.path[:length(v.path) - 32] LEFT JOIN kid ON kid.path = v.path LEFT JOIN ends ON ends.path = v.path JOIN below ON below.path = v.path
"""

#: The others are checked against brute force, library results or held-out accuracy in tests/llm instead.
ORACLE_SQL: dict[str, str] = {"op4_quotes": _QUOTES_SQL, "op11_jaccard": _JACCARD_SQL, "op13_trie": _TRIE_SQL}
