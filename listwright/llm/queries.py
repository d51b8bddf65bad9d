"""Registered queries of this subpackage: `queries()` and `oracle_sql()`, in the form __spark_entry__.py collects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archive, write_archive

    rows = read_archive(*write_archive(table(spark, sf_dir, "pages")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import suffix_report

    return suffix_report(table(spark, sf_dir, "documents"))


def op3_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_report

    return substring_report(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantized, top_k

    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import graded

    return graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hnsw import build_index, nonzero, search

    vectors = nonzero(table(spark, sf_dir, "embeddings"))
    return search(build_index(vectors), vectors.where("vec_id % 100 = 0"), 10)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encoded

    return encoded(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, space_led=True)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitening

    return whitening(table(spark, sf_dir, "embeddings"))


ORACLE_OP1 = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c:
    lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bit FROM page),
digest AS (
  SELECT page_id, html, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j:
      CAST(substr(bit, CAST(1 + 5 * i + j AS BIGINT), 1) AS BIGINT) * CAST(pow(2, 4 - j) AS BIGINT)))::BIGINT, 1)), '') AS payload_digest FROM bits)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to
FROM digest WINDOW same AS (PARTITION BY html)
"""


ORACLE_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLE_OP12 = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM piece),
gram AS (
  SELECT lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM words),
f AS MATERIALIZED (SELECT lang, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM gram GROUP BY lang, phrase HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
cut AS (
  SELECT lang, phrase, f AS a, 1 AS k, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM f WHERE len(w) > 1
  UNION ALL SELECT lang, phrase, f, 2, w[1] || ' ' || w[2], w[3] FROM f WHERE len(w) = 3),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.k, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
held AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM f WHERE len(w) = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM f WHERE len(w) = 3),
longest AS (SELECT lang, phrase, max(f) AS f FROM held GROUP BY lang, phrase),
chosen AS (
  SELECT s.* FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored) s
  LEFT JOIN longest h ON h.lang = s.lang AND h.phrase = s.phrase WHERE nth = 1 AND 100 * coalesce(h.f, 0) < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM chosen)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""


QUERIES: dict[str, Query] = {
    "op1_warc": op1_warc,
    "op2_suffix_array": op2_suffix_array,
    "op3_content_defined_chunks": op3_content_defined_chunks,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_hnsw": op6_hnsw,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_minhash": op10_minhash,
    "op11_weak_supervision": op11_weak_supervision,
    "op12_collocations": op12_collocations,
    "op13_qdwh_whitening": op13_qdwh_whitening,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": ORACLE_OP1, "op4_exact_top_k": ORACLE_OP4, "op12_collocations": ORACLE_OP12}
