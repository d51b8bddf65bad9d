"""Registered queries of feeds, normalization, state tables and checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.operators import buckets
from listwright.operators import normalize as N
from listwright.operators import spec as Q
from listwright.operators import store as S
from listwright.sources import feeds

from .catalog import query, sql_slug, sql_stamp, stamp
from .views import view

NOW = "2024-02-01 00:00:00"


# feeds and normalization: listing rows made of documents, in the feeds' shapes

AGENDA_ROWS = """SELECT CASE WHEN doc_id % 11 <> 0 THEN ' ' || CAST(doc_id AS STRING) || ' ' END AS id, CASE WHEN doc_id % 13 <> 0 THEN text ELSE '  ' END AS title,
  CASE WHEN doc_id % 4 = 0 THEN 'https://x.example/evento/' || CAST(doc_id AS STRING) || '/' END AS url, text AS description, CASE WHEN doc_id % 17 <> 0 THEN '2026-0' || CAST(1 + doc_id % 9 AS STRING) || '-' || CAST(10 + doc_id % 18 AS STRING) END AS startDate,
  CASE WHEN doc_id % 5 = 0 THEN '2026-0' || CAST(1 + doc_id % 9 AS STRING) || '-' || CAST(10 + doc_id % 19 AS STRING) END AS endDate, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN '19:30' ELSE '25:00' END END AS startTime, CASE WHEN doc_id % 6 = 0 THEN '21:00' END AS endTime,
  CASE WHEN doc_id % 7 <> 0 THEN source END AS venueName, CAST(NULL AS STRING) AS address, lang AS neighborhood, doc_id, lang, source, n_chars FROM documents"""


def documents_as(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM documents", "FROM {d}"), d=view(spark, sf_dir, "documents"))


def agenda_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents_as(spark, sf_dir, AGENDA_ROWS)
    return rows.withColumns({
        "categories": F.array("lang", F.lit(" "), "source"), "free": F.when(F.col("doc_id") % 9 == 0, True), "priceValue": F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("double")),
        "imageUrl": F.lit(None).cast("string"), "externalUrl": F.when(F.col("doc_id") % 3 == 0, F.lit("https://t.example/1")),
    })


@query(f"""WITH r AS ({AGENDA_ROWS}), x AS (SELECT *, coalesce(nullif(trim(id), ''), nullif(regexp_extract(url, '/evento/([^/]+)/?$', 1), '')) AS ext, (endDate IS NULL OR endDate = startDate) AND startTime = '19:30' AS timed FROM r)
  SELECT doc_id, CASE WHEN ext IS NULL THEN 'missing id' WHEN trim(title) = '' THEN 'missing name' WHEN startDate IS NULL THEN 'missing date' WHEN NOT coalesce(timed, false) AND endDate < startDate THEN 'endDate is before startDate' END AS reason,
    CASE WHEN ext IS NOT NULL THEN 'agenda-' || ext END AS id, CASE WHEN ext IS NULL OR startDate IS NULL THEN NULL WHEN timed THEN 'timed' ELSE 'date' END AS temporal_kind, CASE WHEN timed AND startDate IS NOT NULL THEN {sql_stamp("CAST(startDate || ' 19:30:00' AS TIMESTAMP) + INTERVAL 3 HOUR")} END AS starts_at,
    CASE WHEN timed AND endTime IS NOT NULL AND startDate IS NOT NULL THEN {sql_stamp("CAST(startDate || ' 21:00:00' AS TIMESTAMP) + INTERVAL 3 HOUR")} END AS ends_at, lang AS category_id, source AS subcategory, {sql_slug('venueName')} AS venue_slug,
    CASE WHEN doc_id % 9 = 0 THEN true WHEN doc_id % 2 = 0 THEN false END AS free, CASE WHEN doc_id % 9 <> 0 AND doc_id % 2 = 0 THEN CAST(n_chars AS DOUBLE) END AS price_min FROM x""")
def normalize_agenda_reasons(spark, sf_dir):
    rows = agenda_rows(spark, sf_dir)
    # the row's number travels as its image
    done = N.normalize_agenda(rows.withColumn("imageUrl", F.col("doc_id").cast("string")), F.lit(NOW), "agenda")
    o = F.col("occurrence")
    return done.select(
        F.col("image_url").cast("long").alias("doc_id"), "reason", "id", F.when(F.col("id").isNotNull() & F.coalesce(o["starts_at"].cast("date"), o["start_date"]).isNotNull(), o["temporal_kind"]).alias("temporal_kind"), stamp(o["starts_at"]).alias("starts_at"), stamp(o["ends_at"]).alias("ends_at"),
        "category_id", F.try_element_at("subcategories", F.lit(1)).alias("subcategory"), F.regexp_replace("venue.id", "^venue-", "").alias("venue_slug"), F.col("price.free").alias("free"), F.col("price.min").alias("price_min"),
    )


def curated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return agenda_rows(spark, sf_dir).withColumns({
        "sourceUrl": F.when(d % 10 == 0, F.lit("ftp://x.example")).otherwise(F.lit("https://x.example/a")), "ticketUrl": F.when(d % 15 == 1, F.lit("no url")), "imageUrl": d.cast("string"),
        "imageRightsConfirmed": F.lit(True), "latitude": F.when(d % 8 == 0, F.lit(-30.0)).when(d % 8 == 1, F.lit(-95.0)), "longitude": F.when(d % 8 == 1, F.lit(-51.0)).when(d % 16 == 0, F.lit(-51.0)), "priceValue": F.when(d % 21 == 2, F.lit(-1.0)),
    })


@query(f"""WITH r AS ({AGENDA_ROWS}), x AS (SELECT *, (endDate IS NULL OR endDate = startDate) AND startTime = '19:30' AS timed FROM r)
  SELECT CASE WHEN id IS NULL THEN 'missing id' WHEN trim(title) = '' THEN 'missing title' WHEN startDate IS NULL THEN 'missing startDate' WHEN venueName IS NULL THEN 'missing venue' WHEN doc_id % 10 = 0 THEN 'invalid sourceUrl'
    WHEN doc_id % 15 = 1 THEN 'invalid ticketUrl' WHEN doc_id % 21 = 2 THEN 'invalid priceValue' WHEN doc_id % 8 = 0 AND doc_id % 16 <> 0 THEN 'one coordinate without the other' WHEN doc_id % 8 = 1 THEN 'coordinates out of range'
    WHEN NOT coalesce(timed, false) AND endDate < startDate THEN 'endDate is before startDate' END AS reason, count(*) AS n FROM x GROUP BY 1""")
def normalize_curated_reasons(spark, sf_dir):
    rows = curated_rows(spark, sf_dir).withColumn("imageUrl", F.lit(None).cast("string"))
    return N.normalize_curated(rows, F.lit(NOW), "curated").groupBy("reason").agg(F.count("*").alias("n"))


TICKET_ROWS = """SELECT doc_id, lang, source, n_chars, text AS name, CASE doc_id % 6 WHEN 0 THEN 'onsale' WHEN 1 THEN 'offsale' WHEN 2 THEN 'canceled' WHEN 3 THEN 'postponed' WHEN 4 THEN 'rescheduled' ELSE 'other' END AS code,
  CASE WHEN doc_id % 7 <> 0 THEN '2026-03-0' || CAST(1 + doc_id % 9 AS STRING) || 'T20:00:00Z' END AS begins FROM documents"""


@query(f"""WITH r AS ({TICKET_ROWS})
  SELECT doc_id, CASE WHEN code = 'other' THEN 'unmappable status: other' WHEN begins IS NULL THEN 'no precise start' END AS reason, CASE code WHEN 'onsale' THEN 'scheduled' WHEN 'offsale' THEN 'scheduled' WHEN 'canceled' THEN 'cancelled' WHEN 'other' THEN NULL ELSE code END AS status,
    {sql_stamp("CAST(begins AS TIMESTAMP)")} AS starts_at, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS category_id, CASE WHEN doc_id % 4 = 0 THEN source END AS venue_name, CASE WHEN doc_id % 4 = 0 THEN -30.5e0 END AS latitude, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id % 5 = 1 END AS free FROM r""")
def normalize_ticket_reasons(spark, sf_dir):
    d = F.col("doc_id")
    rows = documents_as(spark, sf_dir, TICKET_ROWS)
    s = lambda **k: F.struct(*(v.alias(n) for n, v in k.items()))
    none = F.lit(None).cast("string")
    name = lambda c: s(name=c)
    venue = s(id=none, name=F.col("source"), city=name(F.lit("X")), state=s(stateCode=F.lit("RS")), country=s(countryCode=F.when(d % 4 == 0, "BR").when(d % 4 == 1, "US").otherwise("BR")), address=s(line1=none), location=s(latitude=F.when(d % 4 == 0, "-30.5").otherwise("-95"), longitude=F.lit("-51")))
    price = s(type=F.lit("standard"), currency=F.when(d % 5 == 0, "USD").otherwise("BRL"), min=F.when(d % 5 == 1, 0.0).otherwise(5.0), max=F.when(d % 5 == 1, 0.0).otherwise(9.0))
    feed = rows.select(
        "doc_id", d.cast("string").alias("id"), "name", none.alias("url"), none.alias("info"), F.array(s(url=d.cast("string"), ratio=none, width=F.lit(1), height=F.lit(1))).alias("images"), s(start=s(localDate=F.lit("2026-03-01"), localTime=none, dateTime=F.col("begins")), status=s(code=F.col("code"))).alias("dates"),
        F.array(s(primary=F.lit(False), segment=name(F.col("source")), genre=name(none)), s(primary=d % 3 == 0, segment=name(F.col("lang")), genre=name(none))).alias("classifications"), F.array(price).alias("priceRanges"), s(venues=F.array(venue), attractions=F.expr("cast(null as array<struct<id: string, name: string>>)")).alias("_embedded"),
    )
    done = N.normalize_ticket(feed, F.lit(NOW), "tickets")
    return done.select(F.col("image_url").cast("long").alias("doc_id"), "reason", "status", stamp("occurrence.starts_at").alias("starts_at"), "category_id", F.col("venue.name").alias("venue_name"), F.col("venue.latitude").alias("latitude"), F.col("price.free").alias("free"))


@query(f"""WITH r AS ({AGENDA_ROWS}) SELECT coalesce(nullif(trim(id), ''), nullif(regexp_extract(url, '/evento/([^/]+)/?$', 1), '')) AS external_id, coalesce(url, 'https://destinopoa.com.br/agenda/') AS source_url, CAST(1 AS INTEGER) AS schema_version, true AS stable_hash FROM r""")
def raw_envelope(spark, sf_dir):
    rows = agenda_rows(spark, sf_dir).drop("doc_id", "lang", "source", "n_chars")
    turned = rows.select(*reversed(rows.columns))  # another order of keys, the same hash
    raw, other = feeds.agenda_raw(rows, F.lit(NOW)), feeds.agenda_raw(turned, F.lit(NOW))
    hashes = other.select("content_hash").distinct().withColumn("stable_hash", F.lit(True))
    return raw.join(hashes, "content_hash", "left").select("external_id", "source_url", "schema_version", F.coalesce("stable_hash", F.lit(False)).alias("stable_hash"))


@query("""SELECT page_id, len(list_filter(regexp_extract_all(html, '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1), lambda b: regexp_matches(b, '(?i)"@type"\\s*:\\s*"Event"'))) > 0 AS structured_data,
  CAST(len(list_distinct(regexp_extract_all(html, '(?i)href="(/[^"?#]+)"', 1))) AS BIGINT) AS event_links,
  CASE WHEN len(list_distinct(regexp_extract_all(html, '(?i)href="(/[^"?#]+)"', 1))) > 0 THEN 'html' ELSE 'unknown' END AS strategy FROM pages""")
def page_structure_probe(spark, sf_dir):
    return feeds.page_structure(view(spark, sf_dir, "pages"), r'href="(/[^"?#]+)"')


# state


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id, external_id ORDER BY version DESC) AS k FROM v_raw)
  SELECT source_id, external_id, CAST(version AS BIGINT) AS version, md5(payload) AS payload_md5, CASE WHEN external_id IS NULL OR version >= 2 THEN 'pending' ELSE 'normalized' END AS processing_status FROM r
  WHERE external_id IS NULL OR k = 1""")
def raw_upsert_latest(spark, sf_dir):
    raw = view(spark, sf_dir, "v_raw")
    base = F.timestamp_seconds(F.col("version"))
    rows = raw.select(F.concat_ws("-", "source_id", "external_id", "version", F.md5("payload")).alias("id"), "source_id", "external_id", "version", "payload", base.alias("fetched_at"), F.when(F.col("external_id").isNull(), "pending").otherwise("normalized").alias("processing_status"), F.lit(None).cast("string").alias("processing_error"))
    old = S.latest(rows.where("external_id is not null and version < 2"), ["source_id", "external_id"], F.desc("version")).select(*rows.columns).unionByName(rows.where("external_id is null and version < 2"))
    new = rows.where("version >= 2").drop("processing_status", "processing_error")
    return S.upsert_raw(old, new).select("source_id", "external_id", "version", F.md5("payload").alias("payload_md5"), "processing_status")


LATEST = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY source_id, external_id ORDER BY version DESC) AS k FROM v_raw WHERE external_id IS NOT NULL)
  SELECT source_id, external_id, CAST(version AS BIGINT) AS version, md5(payload) AS payload_md5 FROM r WHERE k = 1"""


@query(LATEST)
def bucketed_upsert(spark, sf_dir):
    """Two upserts of a stored table in 16 buckets: first the early versions of all payloads, then the later ones."""
    raw = view(spark, sf_dir, "v_raw").where("external_id is not null").withColumn("version", F.col("version").cast("long"))
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{folder.rstrip('/')}/raw-{uuid.uuid4().hex}"
    keys = ["source_id", "external_id"]
    buckets.create(spark, path, "source_id string, external_id string, version bigint, role string, payload string", keys, 16)
    for part in ("version < 2", "version >= 2"):
        batch = S.latest(raw.where(part), keys, F.desc("version"))
        buckets.upsert(spark, path, batch, lambda old, new: S.upsert(old, new, keys))
    return buckets.read(spark, path).select("source_id", "external_id", "version", F.md5("payload").alias("payload_md5"))


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "v_raw")
    return r.select("source_id", "external_id", "version", "role", "payload", F.lit("pending").alias("processing_status"), F.lit(None).cast("string").alias("processing_error"))


@query("""SELECT source_id, external_id, CAST(version AS BIGINT) AS version, CASE WHEN external_id IS NULL THEN 'pending' WHEN CAST(external_id AS INT) % 5 = 0 THEN 'failed' WHEN CAST(external_id AS INT) % 5 = 1 THEN 'pending' ELSE 'normalized' END AS processing_status,
  CASE WHEN CAST(external_id AS INT) % 5 = 0 THEN 'no date' END AS processing_error FROM v_raw""")
def raw_mark_processed(spark, sf_dir):
    raw = raw_rows(spark, sf_dir)
    n = F.col("external_id").cast("int") % 5
    outcomes = raw.select("source_id", "external_id", F.when(n == 0, "failed").otherwise("normalized").alias("status"), F.when(n == 0, "no date").alias("error")).where(F.coalesce(n, F.lit(0)) != 1).distinct()
    return S.mark_processed(raw, outcomes).select("source_id", "external_id", "version", "processing_status", "processing_error")


@query("SELECT source_id, external_id, CAST(version AS BIGINT) AS version FROM v_raw WHERE CAST(external_id AS INT) % 10 = 3")
def raw_lookup(spark, sf_dir):
    raw = raw_rows(spark, sf_dir)
    keys = raw.where("cast(external_id as int) % 10 = 3").select("source_id", "external_id").distinct()
    return S.with_keys(raw, keys, ["source_id", "external_id"]).select("source_id", "external_id", "version")


@query("""WITH p AS (SELECT *, json_extract_string('{"id": "' || conv_id || '", "title": "' || role || '"}', '$.id') AS own FROM conversations) SELECT own AS raw_external_id, own AS id, role AS title FROM p WHERE turn = 1""")
def reprocess_pending(spark, sf_dir):
    talk = view(spark, sf_dir, "conversations")
    key = F.col("conv_id").cast("string")
    raw = talk.select(F.lit("s").alias("source_id"), key.alias("external_id"), F.to_json(F.struct(key.alias("id"), F.col("role").alias("title"))).alias("payload"), F.when(F.col("turn") == 1, "pending").otherwise("normalized").alias("processing_status"))
    return S.pending(raw, "id string, title string").select("raw_external_id", "id", "title")


def event_rows(spark: SparkSession, sf_dir: str, where: str, day: int) -> DataFrame:
    at = F.lit(f"2024-03-{day:02d} 00:00:00").cast("timestamp")
    e = view(spark, sf_dir, "v_events").where(where)
    return e.select("id", F.concat(F.col("title"), F.lit(f" v{day}")).alias("title"), F.when(F.lit(day == 1), F.col("category_id")).alias("category_id"), at.alias("first_seen_at"), at.alias("last_seen_at"), at.alias("created_at"), at.alias("updated_at"))


@query("""SELECT id, title || CASE WHEN doc_id % 2 = 0 THEN ' v2' ELSE ' v1' END AS title, CASE WHEN doc_id % 2 <> 0 THEN category_id END AS category_id, CASE WHEN doc_id % 3 <> 0 THEN '2024-03-01' ELSE '2024-03-02' END AS first_seen,
  CASE WHEN doc_id % 2 = 0 THEN '2024-03-02' ELSE '2024-03-01' END AS last_seen, CASE WHEN doc_id % 3 <> 0 THEN '2024-03-01' ELSE '2024-03-02' END AS created FROM v_events WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def canonical_upsert_preserve(spark, sf_dir):
    old, new = event_rows(spark, sf_dir, "doc_id % 3 <> 0", 1), event_rows(spark, sf_dir, "doc_id % 2 = 0", 2)
    rows = S.upsert_events(old, new)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.select("id", "title", "category_id", day("first_seen_at").alias("first_seen"), day("last_seen_at").alias("last_seen"), day("created_at").alias("created"))


@query("SELECT event_id, id FROM v_occurrences WHERE CAST(event_id AS INT) % 3 <> 0 UNION ALL SELECT event_id, id || '-new' FROM v_occurrences WHERE CAST(event_id AS INT) % 3 = 0 AND id LIKE '%-occ-1'")
def occurrences_replace(spark, sf_dir):
    old = view(spark, sf_dir, "v_occurrences").select("event_id", "id")
    new = old.where("cast(event_id as int) % 3 = 0 and id like '%-occ-1'").select("event_id", F.concat("id", F.lit("-new")).alias("id"))
    return S.replace_children(old, new, new.select(F.col("event_id").alias("id")))


@query("""SELECT event_id, source_id, confidence, '2024-01-01' AS first_seen FROM v_refs WHERE CAST(event_id AS INT) % 4 <> 0
  UNION ALL SELECT event_id, source_id, 1e0, '2024-01-01' FROM v_refs WHERE CAST(event_id AS INT) % 4 = 0 AND source_id NOT LIKE '%-b'
  UNION ALL SELECT DISTINCT event_id, 'added', 1e0, '2024-05-05' FROM v_refs WHERE CAST(event_id AS INT) % 4 = 0""")
def source_refs_reconcile(spark, sf_dir):
    day = lambda x: F.lit(x).cast("timestamp")
    old = view(spark, sf_dir, "v_refs").withColumn("first_seen_at", day("2024-01-01"))
    own = old.where("cast(event_id as int) % 4 = 0")
    new = own.where("source_id not like '%-b'").select("event_id", "source_id", F.lit(1.0).alias("confidence"), day("2024-05-05").alias("first_seen_at"))
    new = new.unionByName(own.select("event_id", F.lit("added").alias("source_id"), F.lit(1.0).alias("confidence"), day("2024-05-05").alias("first_seen_at")).distinct())
    rows = S.reconcile_refs(old, new, own.select(F.col("event_id").alias("id")))
    return rows.select("event_id", "source_id", "confidence", F.date_format("first_seen_at", "yyyy-MM-dd").alias("first_seen"))


@query("""SELECT id, CASE WHEN id % 2 = 0 THEN name || ' 3' ELSE name END AS name, city FROM v_venues WHERE id < 20 OR id % 2 = 0""")
def venues_upsert(spark, sf_dir):
    v = view(spark, sf_dir, "v_venues").select("id", "name", "city")
    versions = v.where("id % 2 = 0").withColumn("seen_at", F.explode(F.sequence(F.lit(1), F.lit(3))))
    new = versions.withColumn("name", F.concat_ws(" ", "name", F.col("seen_at").cast("string")))
    return S.upsert_venues(v.where("id < 20"), new)


@query("SELECT id, title FROM v_events WHERE doc_id % 50 = 1")
def events_by_id(spark, sf_dir):
    e = view(spark, sf_dir, "v_events")
    keys = e.where("doc_id % 50 = 1").select("id").unionByName(e.select(F.lit("none").alias("id")).limit(1))
    return S.with_keys(e, keys, ["id"]).select("id", "title")


@query("""WITH o AS (SELECT event_id, string_agg(id, ',' ORDER BY id) AS occurrence_ids FROM v_occurrences GROUP BY event_id), r AS (SELECT event_id, string_agg(source_id, ',' ORDER BY source_id) AS source_ids FROM v_refs GROUP BY event_id)
  SELECT e.id, occurrence_ids, source_ids, v.name AS venue_name FROM v_events e LEFT JOIN o ON o.event_id = e.id LEFT JOIN r ON r.event_id = e.id LEFT JOIN v_venues v ON v.id = e.venue_id""")
def hydrate_nested(spark, sf_dir):
    rows = S.hydrate(*(view(spark, sf_dir, n) for n in ("v_events", "v_occurrences", "v_venues", "v_refs")))
    join = lambda c, k: F.array_join(F.transform(c, lambda x: x[k]), ",")
    return rows.select("id", join("occurrences", "id").alias("occurrence_ids"), join("sources", "source_id").alias("source_ids"), F.col("venue.name").alias("venue_name"))


@query("""SELECT 'repeated_title' AS violation, title AS key, count(*) AS rows FROM v_events GROUP BY title HAVING count(*) > 1
  UNION ALL SELECT 'unknown_venue', CAST(venue_id AS VARCHAR), count(*) FROM v_events e WHERE venue_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v_venues v WHERE v.id = e.venue_id) GROUP BY venue_id""")
def table_checks(spark, sf_dir):
    e, v = view(spark, sf_dir, "v_events"), view(spark, sf_dir, "v_venues")
    return S.duplicates(e, ["title"], "repeated_title").unionByName(S.orphans(e, "venue_id", v, "id", "unknown_venue"))


@query("""WITH o AS (SELECT id, CASE WHEN CAST(event_id AS INT) % 9 = 0 THEN 'odd' ELSE temporal_kind END AS kind, starts_at, start_date, CASE WHEN CAST(event_id AS INT) % 12 = 0 THEN DATE '2023-12-31' ELSE end_date END AS end_date FROM v_occurrences)
  SELECT id, array_to_string(list_filter([CASE WHEN kind NOT IN ('timed', 'date') THEN 'unknown_kind' END, CASE WHEN CASE WHEN kind = 'timed' THEN starts_at IS NULL OR start_date IS NOT NULL OR end_date IS NOT NULL ELSE start_date IS NULL OR starts_at IS NOT NULL END THEN 'kind_shape' END,
    CASE WHEN end_date < start_date THEN 'date_order' END], lambda x: x IS NOT NULL), ',') AS violations FROM o WHERE kind = 'odd' OR end_date < start_date OR (kind = 'timed' AND end_date IS NOT NULL)""")
def invariant_violations(spark, sf_dir):
    n = F.col("event_id").cast("int")
    o = view(spark, sf_dir, "v_occurrences").withColumns({"temporal_kind": F.when(n % 9 == 0, "odd").otherwise(F.col("temporal_kind")), "end_date": F.when(n % 12 == 0, F.lit("2023-12-31").cast("date")).otherwise(F.col("end_date")), "ends_at": F.lit(None).cast("timestamp")})
    return N.violations(o, "id", N.occurrence_rules()).select("id", F.array_join("violations", ",").alias("violations"))


@query("""SELECT source AS id, max(n_chars) AS authority, CASE WHEN source < 'src15' THEN '2024-01-01' ELSE '2024-02-01' END AS created, '2024-02-01' AS updated FROM documents GROUP BY source""")
def sources_upsert(spark, sf_dir):
    day = lambda x: F.lit(x).cast("timestamp")
    src = view(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.max("n_chars").alias("authority"))
    old = src.where("id < 'src15'").select("id", (F.col("authority") - 1).alias("authority"), day("2024-01-01").alias("created_at"), day("2024-01-01").alias("updated_at"))
    rows = S.upsert_sources(old, src, day("2024-02-01"))
    return rows.select("id", "authority", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(f"""WITH r AS ({AGENDA_ROWS}), x AS (SELECT *, coalesce(nullif(trim(id), ''), nullif(regexp_extract(url, '/evento/([^/]+)/?$', 1), '')) AS ext, (endDate IS NULL OR endDate = startDate) AND startTime = '19:30' AS timed FROM r),
  y AS (SELECT ext IS NULL OR trim(title) = '' OR startDate IS NULL OR (NOT coalesce(timed, false) AND coalesce(endDate < startDate, false)) AS bad FROM x)
  SELECT 'agenda' AS source_id, count(*) AS discovered, count(*) AS raw_saved, count(*) FILTER (NOT bad) AS normalized, count(*) FILTER (NOT bad) AS canonical_saved, count(*) FILTER (bad) AS failed FROM y""")
def ingest_summary(spark, sf_dir):
    return S.ingestion_summary(N.normalize_agenda(agenda_rows(spark, sf_dir), F.lit(NOW), "agenda"))


@query("""SELECT 'events' AS kind, count(*) AS n FROM v_events WHERE id NOT LIKE '1%' UNION ALL SELECT 'occurrences', count(*) FROM v_occurrences WHERE event_id NOT LIKE '1%' UNION ALL SELECT 'refs', count(*) FROM v_refs WHERE event_id NOT LIKE '1%'
  UNION ALL SELECT 'pairs', count(*) FROM v_events a JOIN v_events b ON b.doc_id = a.doc_id + 1 WHERE a.id NOT LIKE '1%' AND b.id NOT LIKE '1%'""")
def scoped_delete(spark, sf_dir):
    e, o, r = (view(spark, sf_dir, n) for n in ("v_events", "v_occurrences", "v_refs"))
    pairs = e.select("doc_id", F.col("id").alias("left_id")).join(e.select((F.col("doc_id") - 1).alias("doc_id"), F.col("id").alias("right_id")), "doc_id")
    parts = zip(("events", "occurrences", "refs", "pairs"), S.without_prefix(e, o, r, pairs, "1"), strict=True)
    return S.together(*(p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in parts))


@query("SELECT id, source_id FROM v_events WHERE source_id IN ('src1', 'src2')")
def multi_source_union(spark, sf_dir):
    e = view(spark, sf_dir, "v_events").select("id", "source_id")
    return S.together(*(e.where(F.col("source_id") == s) for s in ("src1", "src2")))


# specified in documents only


@query("""SELECT e.id, round(0.15e0 + 0.20e0 + CASE WHEN venue_id IS NOT NULL THEN 0.15e0 ELSE 0 END + CASE WHEN latitude IS NOT NULL THEN 0.10e0 ELSE 0 END + 0.10e0 + CASE WHEN free IS NOT NULL THEN 0.05e0 ELSE 0 END + CASE WHEN doc_id % 8 = 0 THEN 0.10e0 ELSE 0 END, 6) AS quality,
  round(0.30e0 * (doc_id % 10) / 10 + 0.30e0 * 0.5e0 + 0.20e0 * (0.5e0 + (doc_id % 5) / 10e0), 6) AS ranking FROM v_events e LEFT JOIN v_venues v ON v.id = e.venue_id""")
def spec_scores(spark, sf_dir):
    e, v = view(spark, sf_dir, "v_events"), view(spark, sf_dir, "v_venues").select(F.col("id").alias("venue_id"), "latitude")
    d = F.col("doc_id")
    yes = F.lit(True)
    has = {"title": yes, "date": yes, "venue": F.col("venue_id").isNotNull(), "geo": F.col("latitude").isNotNull(), "description": yes, "price": F.col("free").isNotNull(), "multiple_sources": d % 8 == 0}
    parts = {"freshness": (d % 10) / 10, "quality": F.lit(0.5), "source_confidence": 0.5 + (d % 5) / 10}
    return e.join(v, "venue_id", "left").select("id", F.round(Q.quality_score(has), 6).alias("quality"), F.round(Q.ranking_score(parts), 6).alias("ranking"))


@query("""WITH k AS (SELECT *, min(id) OVER (PARTITION BY title) AS first FROM v_events) SELECT first AS left_id, id AS right_id FROM k WHERE id <> first""")
def spec_deterministic_pairs(spark, sf_dir):
    return Q.deterministic_pairs(view(spark, sf_dir, "v_events").select("id", "title"), [["title"]])


@query("""WITH r AS (SELECT source_id, count(*) AS ingested, count(*) FILTER (role = 'user') AS failed FROM v_raw GROUP BY 1), e AS (SELECT CAST(doc_id % 4 AS VARCHAR) AS source_id, count(*) FILTER (venue_id IS NULL) AS no_venue, count(*) FILTER (free IS NULL) AS no_price FROM v_events GROUP BY 1)
  SELECT r.source_id, ingested, failed, no_venue, no_price FROM r JOIN e ON e.source_id = r.source_id""")
def spec_data_metrics(spark, sf_dir):
    raw = view(spark, sf_dir, "v_raw").withColumn("processing_status", F.when(F.col("role") == "user", "failed").otherwise("normalized"))
    events = view(spark, sf_dir, "v_events").withColumn("source_id", (F.col("doc_id") % 4).cast("string"))
    return Q.data_metrics(raw, events)


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'undecided' WHEN o_orderdate <= TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'kept' END AS retention, count(*) AS n FROM orders GROUP BY 1")
def spec_retention(spark, sf_dir):
    rows = view(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp")).alias("retention_until"))
    return Q.retention(rows, F.lit("1996-01-01").cast("timestamp")).groupBy("retention").agg(F.count("*").alias("n"))


@query("""SELECT id, 'title' AS field, title AS previous, title || '!' AS "current" FROM v_events WHERE doc_id % 4 = 0 UNION ALL SELECT id, 'category_id', category_id, NULL FROM v_events WHERE doc_id % 6 = 0""")
def spec_change_log(spark, sf_dir):
    e = view(spark, sf_dir, "v_events").select("id", "doc_id", "title", "category_id", "status")
    new = e.withColumns({"title": F.when(F.col("doc_id") % 4 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")), "category_id": F.when(F.col("doc_id") % 6 != 0, F.col("category_id"))})
    return Q.change_log(e, new, "id", ["title", "category_id", "status"])


@query("SELECT source_id, external_id, CAST(version AS BIGINT) AS version FROM v_raw WHERE version = 1 AND (external_id IS NULL OR CAST(external_id AS INT) % 3 = 0)")
def spec_changed_only(spark, sf_dir):
    r = view(spark, sf_dir, "v_raw").where("version = 1").withColumn("content_hash", F.md5("payload"))
    old = r.where("external_id is not null").select("source_id", "external_id", F.when(F.col("external_id").cast("int") % 3 == 0, F.lit("other")).otherwise(F.col("content_hash")).alias("content_hash"))
    return Q.changed_only(old, r).select("source_id", "external_id", "version")


