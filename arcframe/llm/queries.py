"""One query for each operator of this subpackage, over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_layout import extract_text
from .jaccard import jaccard_groups
from .langid import identify_languages
from .media import media_round_trip
from .mixing import mix_sources
from .near_vectors import near_vectors
from .packing import pack_documents
from .pii import pseudonymize_documents
from .secrets import ASSIGN_HEAD, ASSIGN_LEAST, BASE, KINDS, LIVE_OWNERS, digest, scan_secrets
from .tokencount import count_tokens

BYTE_BPE = "byte_bpe_50k.json"
#: The query's key is public, for repeatable results; a deployment passes its own.
PII_KEY = b"op6"


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize_documents(table(spark, sf_dir, "documents"), PII_KEY)


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(table(spark, sf_dir, "documents")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_language_id": op3_language_id,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_html_text": op5_html_text,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_near_vectors": op7_near_vectors,
    "op8_secret_scans": op8_secret_scans,
    "op9_token_counts": op9_token_counts,
    "op10_source_mixing": op10_source_mixing,
}

# --- oracles, where SQL can say the same -----------------------------------------------------------------

_REACH = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
lowest AS (SELECT a, least(a, min(b)) AS low FROM reach GROUP BY a)
"""

_OP2 = f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM worded),
sized AS (SELECT doc_id, len(s) AS n FROM shingled),
items AS (SELECT doc_id, unnest(s) AS x FROM shingled),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM items p JOIN items q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sized sa ON sa.doc_id = a JOIN sized sb ON sb.doc_id = b WHERE 100 * k >= 85 * (sa.n + sb.n - k)),
{_REACH}
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(low, doc_id) AS component_id FROM sized LEFT JOIN lowest ON a = doc_id
"""

_OP7 = f"""
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
good AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM vectors WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id < q.vec_id WHERE p.norm > 0 AND q.norm > 0 AND list_dot_product(p.v, q.v) / (p.norm * q.norm) >= 0.95),
{_REACH},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN lowest ON lowest.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""


def _op8() -> str:
    """Spans by splitting at the patterns. Possessive marks and the look-ahead only save time; SQL has neither."""
    plain = {k: p.replace("}+", "}").replace("*+", "*").replace("'", "''") for k, p in KINDS.items()}
    least = {k: ASSIGN_LEAST if k == "assign" else 1 for k in KINDS}
    parts = []
    for rank, (kind, pattern) in enumerate(plain.items()):
        value = f"regexp_replace(m[i], '^{ASSIGN_HEAD.replace(chr(39), chr(39) * 2)}', '')" if kind == "assign" else "m[i]"
        parts.append(
            f"SELECT doc_id, owner, '{kind}' AS kind, {rank} AS rank, {value} AS value, list_sum([length(x) FOR x IN g[:i]]) + coalesce(list_sum([length(x) FOR x IN m[:i - 1]]), 0) AS a, length(m[i]) AS size "
            f"FROM (SELECT doc_id, owner, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, owner, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM texts) WHERE len(m) > 0) WHERE length({value}) >= {least[kind]}"
        )
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH texts AS (SELECT doc_id, coalesce('+' || source, '-') AS owner, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
owned AS (SELECT value, count(DISTINCT owner) AS owners FROM spans GROUP BY value),
judged AS (SELECT doc_id, kind, rank, CAST(a AS BIGINT) AS a, CAST(a + size AS BIGINT) AS b, owners <= {LIVE_OWNERS} AS live FROM spans JOIN owned USING (value) WHERE owners <= {LIVE_OWNERS} OR kind IN ({base})),
said AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (WHERE kind IN ({base})) AS base FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN said USING (doc_id)
"""


ORACLES: dict[str, str] = {"op2_ngram_jaccard": _OP2, "op7_near_vectors": _OP7, "op8_secret_scans": _op8()}
