"""Queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspan.llm.bpe import bpe_round_trip
from larkspan.llm.common import table
from larkspan.llm.decontamination import contamination
from larkspan.llm.exact_dedup import exact_dedup
from larkspan.llm.html_text import extract_main_text
from larkspan.llm.jaccard import ngram_jaccard_join
from larkspan.llm.license_scan import license_scan
from larkspan.llm.pseudo_likelihood import pseudo_likelihood
from larkspan.llm.resampling import importance_resampling
from larkspan.llm.secrets import secret_scan
from larkspan.llm.suffix_dedup import suffix_dedup
from larkspan.llm.token_files import token_file_digest
from larkspan.llm.toxicity import toxicity
from larkspan.llm.vector_codes import vector_codes


def vocabulary() -> str:
    """Where the tokeniser file is; it is read on the driver and shipped."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(operator: Callable[..., DataFrame], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = operator(table(spark, sf_dir, "documents"))
        return found.select(*columns) if columns else found

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _documents(secret_scan),
    "op2_bpe": _documents(lambda d: bpe_round_trip(d, vocabulary())),
    "op3_lm_score": _documents(pseudo_likelihood),
    "op4_exact_dedup": _documents(exact_dedup, "doc_id", "keep_id", "group_size", "kept", "text_sha256"),
    "op5_html_text": lambda spark, sf_dir: extract_main_text(table(spark, sf_dir, "pages")),
    "op6_decontamination": lambda spark, sf_dir: contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op7_jaccard_join": _documents(lambda d: ngram_jaccard_join(d, size=3, percent=90)),
    "op8_toxicity": lambda spark, sf_dir: toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_token_files": _documents(lambda d: token_file_digest(d, vocabulary())),
    "op10_suffix_dedup": _documents(suffix_dedup, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
    "op11_license_scan": _documents(license_scan, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"),
    "op12_importance_resampling": lambda spark, sf_dir: importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_vector_codes": lambda spark, sf_dir: vector_codes(table(spark, sf_dir, "embeddings")),
}


def _assigned(books: str, name: str) -> str:
    """DuckDB: every part with its nearest entry of ``books``; the packed minimum breaks ties by number."""
    return f"""{name} AS (
  SELECT vec_id, part, x, m % 64 AS e, m // 64 AS d FROM (
    SELECT p.vec_id, p.part, any_value(p.x) AS x, min(CAST(list_sum(list_transform(p.x, lambda v, i: (v - b.x[i]) * (v - b.x[i]))) AS BIGINT) * 64 + b.e) AS m
    FROM parts p JOIN {books} b ON p.part = b.part GROUP BY p.vec_id, p.part))"""


def _moved(books: str, assigned: str, name: str) -> str:
    """DuckDB: the entries at the floor of their parts' mean."""
    return f"""{name} AS (
  SELECT b.part, b.e, coalesce(n.x, b.x) AS x FROM {books} b LEFT JOIN (
    SELECT part, e, list(CAST(floor(t / c) AS BIGINT) ORDER BY i) AS x FROM (
      SELECT part, e, i, sum(x[i]) AS t, count(*) AS c FROM {assigned}, range(1, 5) r(i) GROUP BY part, e, i) GROUP BY part, e) n ON b.part = n.part AND b.e = n.e)"""

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
FROM t WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id)
""",
    "op12_importance_resampling": r"""
WITH tables AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
), texts AS (
  SELECT doc_id AS id, coalesce(text, '') AS text, 'd' AS side FROM documents UNION ALL SELECT item_id, coalesce(text, ''), 'b' FROM benchmark
), cut AS (
  SELECT id, side, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM texts
), each AS (SELECT id, side, unnest(words) AS w FROM cut
), spelt AS (SELECT DISTINCT w, hex(w) AS h FROM each
), bytes AS (
  SELECT w, list_transform(range(1, length(h), 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1) AS b FROM spelt
), hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS bucket FROM bytes, tables
), counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM each JOIN hashed USING (w) GROUP BY bucket
), whole AS (SELECT sum(s) AS s, sum(t) AS t FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(c.t AS DOUBLE) + 1) * (CAST(w.s AS DOUBLE) + 10000) / ((CAST(c.s AS DOUBLE) + 1) * (CAST(w.t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM counts c, whole w
), sums AS (SELECT id, sum(gain) AS total FROM each JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id
), weights AS (
  SELECT id AS doc_id, len(words) AS n_features, CASE WHEN len(words) > 0 THEN CAST(floor(total / len(words)) AS BIGINT) ELSE 0 END AS weight,
         list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', substr(sha256('2024:' || id), i, 1)) - 1) * CAST(16 ** (8 - i) AS BIGINT))) AS h
  FROM cut LEFT JOIN sums USING (id) WHERE side = 'd'
), scores AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM weights
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scores s LEFT JOIN ranked r ON s.doc_id = r.doc_id
""",
    "op13_vector_codes": f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT vec_id, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM kept, range(16) r(part)
), seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64
), b0 AS (SELECT part, e, x FROM parts JOIN seeds USING (vec_id)),
{_assigned("b0", "a1")}, {_moved("b0", "a1", "b1")}, {_assigned("b1", "a2")}, {_moved("b1", "a2", "b2")}, {_assigned("b2", "a3")},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), digest
""",
}
