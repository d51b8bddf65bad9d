"""Stand-in tables: the shapes of the listings tables from the driver's tables, one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: A title of six words or so of whole fields, with accents, punctuation and a word that carries no meaning.
TITLE = """CASE lang WHEN 'fr' THEN 'Fête' WHEN 'de' THEN 'Führung' WHEN 'es' THEN 'Canción' ELSE 'Show' END || ' ' || coalesce(p_name, source) || ' de ' || source || ': ' || CAST(n_chars AS STRING)"""

VIEWS = {
    "v_events": f"""SELECT CAST(doc_id AS STRING) AS id, doc_id, {TITLE} AS title, text AS description, lang AS category_id,
  CASE WHEN doc_id % 10 = 0 THEN 'cancelled' WHEN doc_id % 10 = 1 THEN 'postponed' ELSE 'scheduled' END AS status,
  CASE WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 5 = 1 THEN NULL ELSE false END AS free,
  CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 30 AS INT) END AS venue_id, source AS source_id
FROM documents LEFT JOIN part ON p_partkey = doc_id % 200""",
    "v_occurrences": """SELECT CAST(doc_id AS STRING) || '-occ-1' AS id, CAST(doc_id AS STRING) AS event_id,
  CASE WHEN doc_id % 3 = 0 THEN 'date' ELSE 'timed' END AS temporal_kind,
  CASE WHEN doc_id % 3 <> 0 THEN make_timestamp(2024, 1, CAST(1 + ascii(text) % 7 AS INT), CAST(doc_id % 24 AS INT), 0, 0) END AS starts_at,
  CASE WHEN doc_id % 3 = 0 THEN make_date(2024, 1, CAST(1 + ascii(text) % 7 AS INT)) END AS start_date,
  CASE WHEN doc_id % 6 = 0 THEN make_date(2024, 1, CAST(1 + ascii(text) % 7 + doc_id % 4 AS INT)) END AS end_date
FROM documents
UNION ALL
SELECT CAST(doc_id AS STRING) || '-occ-2', CAST(doc_id AS STRING), 'timed',
  make_timestamp(2024, 1, CAST(15 + doc_id % 10 AS INT), 20, 30, 0), CAST(NULL AS DATE), CAST(NULL AS DATE)
FROM documents WHERE doc_id % 4 = 0""",
    "v_venues": """SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS STRING) AS city,
  CASE WHEN n_nationkey % 7 <> 0 THEN -30.0e0 - n_nationkey / 1000e0 END AS latitude,
  CASE WHEN n_nationkey % 7 <> 0 THEN -51.2e0 - (n_nationkey * 7 % 25) / 1000e0 END AS longitude
FROM nation""",
    "v_refs": """SELECT CAST(doc_id AS STRING) AS event_id, source AS source_id, 0.5e0 + (doc_id % 5) / 10e0 AS confidence FROM documents
UNION ALL
SELECT CAST(doc_id AS STRING), source || '-b', 0.9e0 FROM documents WHERE doc_id % 8 = 0""",
    "v_raw": """SELECT CAST(conv_id % 4 AS STRING) AS source_id, CASE WHEN conv_id % 9 <> 0 THEN CAST(conv_id AS STRING) END AS external_id,
  turn AS version, role, text AS payload FROM conversations""",
    "v_analytics": """SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'event_view'
  WHEN 'purchase' THEN 'ticket_click' WHEN 'signup' THEN 'share' ELSE event_type END AS event_name, props FROM events""",
    "v_labelled": """SELECT CAST(l.doc_id AS STRING) AS case_id,
  CASE WHEN l.toxic = 1 THEN 'uncertain' WHEN l.quality = 1 THEN 'same' ELSE 'different' END AS truth,
  CASE WHEN l.toxic = 1 THEN 'review' WHEN l.quality = 1 THEN 'auto_merge' ELSE 'separate' END AS expected_routing,
  CASE WHEN d.n_chars >= 1500 THEN 'auto_merge' WHEN d.n_chars >= 300 THEN 'review' ELSE 'separate' END AS routing,
  CASE WHEN d.n_chars % 3 = 0 THEN 'easy' WHEN d.n_chars % 3 = 1 THEN 'medium' ELSE 'hard' END AS difficulty
FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
}
TABLE = re.compile(r"\b(FROM|JOIN) (\w+)")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table; an unqualified name is the driver's table itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {t for _, t in TABLE.findall(VIEWS[name])}
    sql = TABLE.sub(r"\1 {\2}", VIEWS[name])
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_views(sql: str) -> str:
    """An oracle's SQL with the stand-ins it names, as common table expressions before its own."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    if not used:
        return body
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
