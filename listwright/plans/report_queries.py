"""Registered queries of reports, gates, analytics and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.operators import discover as D
from listwright.operators import export as X
from listwright.operators import reports as R
from listwright.operators.store import hydrate

from .catalog import OCC, query, sql_slug
from .views import view

CANDIDATES = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'auto_approved' WHEN 1 THEN 'pending_review' WHEN 2 THEN 'confirmed_same' WHEN 3 THEN 'confirmed_different' ELSE 'separate' END AS status FROM documents"
RAW_STATUS = "CASE WHEN version = 0 THEN 'pending' WHEN version % 3 = 0 THEN 'failed' ELSE 'normalized' END"
BRAND = "Agenda"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("version")
    status = F.when(v == 0, "pending").when(v % 3 == 0, "failed").otherwise("normalized")
    return view(spark, sf_dir, "v_raw").withColumns({"processing_status": status, "fetched_at": v})


@query(f"""SELECT (SELECT count(*) FROM v_events) AS events, (SELECT count(*) FROM v_raw WHERE {RAW_STATUS} = 'pending') AS raw_pending, (SELECT count(*) FROM v_raw WHERE {RAW_STATUS} = 'failed') AS raw_failed,
  count(*) FILTER (status = 'pending_review') AS dedup_pending_review, count(*) FILTER (status = 'auto_approved') AS dedup_auto_approved, count(*) FILTER (status = 'confirmed_same') AS dedup_confirmed_same, count(*) FILTER (status = 'confirmed_different') AS dedup_confirmed_different FROM ({CANDIDATES})""")
def ops_counts(spark, sf_dir):
    pairs = spark.sql(CANDIDATES.replace("FROM documents", "FROM {d}"), d=view(spark, sf_dir, "documents"))
    return R.ops_counts(view(spark, sf_dir, "v_events"), raw(spark, sf_dir), pairs)


@query(f"""WITH s AS (SELECT DISTINCT source_id FROM v_raw UNION SELECT 'none'), r AS (SELECT source_id, max(version) AS last_fetched_at, count(*) FILTER ({RAW_STATUS} = 'normalized') AS raw_normalized, count(*) FILTER ({RAW_STATUS} = 'failed') AS raw_failed FROM v_raw GROUP BY 1),
  e AS (SELECT CAST(CAST(event_id AS INT) % 4 AS VARCHAR) AS source_id, count(DISTINCT event_id) AS events FROM v_refs GROUP BY 1)
  SELECT s.source_id, last_fetched_at, coalesce(raw_normalized, 0) AS raw_normalized, coalesce(raw_failed, 0) AS raw_failed, coalesce(events, 0) AS events FROM s LEFT JOIN r ON r.source_id = s.source_id LEFT JOIN e ON e.source_id = s.source_id""")
def source_health(spark, sf_dir):
    own = raw(spark, sf_dir)
    sources = own.select(F.col("source_id").alias("id")).distinct().unionByName(own.select(F.lit("none").alias("id")).limit(1))
    refs = view(spark, sf_dir, "v_refs").withColumn("source_id", (F.col("event_id").cast("int") % 4).cast("string"))
    return R.source_health(sources, own, refs)


@query("""WITH a AS (SELECT event_id, event_name, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN repeat('x', 201) ELSE CAST(event_id AS VARCHAR) END AS id, event_id % 13 AS m FROM v_analytics)
  SELECT event_id, CASE WHEN event_name = 'error' THEN 'unknown event_name' WHEN id = '' OR length(id) > 200 THEN 'bad event_id' WHEN m = 1 THEN 'metadata key not allowed: k' WHEN m = 3 THEN 'metadata value not a scalar: free' WHEN m = 2 THEN 'metadata value too long: period' END AS reason FROM a""")
def analytics_validation(spark, sf_dir):
    e, m = F.col("event_id"), F.col("event_id") % 13
    pair = lambda k, v: F.create_map(F.lit(k), v)
    metadata = F.when(m == 1, pair("k", F.lit("1"))).when(m == 2, pair("period", F.repeat(F.lit("y"), 65))).when(m == 3, pair("free", F.lit("[1]"))).when(m == 4, pair("category", F.lit("music")))
    rows = view(spark, sf_dir, "v_analytics").select(e.alias("row"), "event_name", F.when(e % 7 == 0, "").when(e % 11 == 0, F.repeat(F.lit("x"), 201)).otherwise(e.cast("string")).alias("event_id"), metadata.alias("metadata"))
    return R.validated_analytics(rows).select(F.col("row").alias("event_id"), "reason")


@query("""WITH n AS (SELECT unnest(['page_view', 'event_view', 'search', 'filter_used', 'nearby_used', 'map_opened', 'share', 'ticket_click', 'maps_click']) AS event_name), c AS (SELECT event_name, count(*) AS n FROM v_analytics GROUP BY 1)
  SELECT n.event_name, coalesce(c.n, 0) AS n FROM n LEFT JOIN c ON c.event_name = n.event_name""")
def product_counts(spark, sf_dir):
    return R.product_counts(view(spark, sf_dir, "v_analytics"))


@query("""SELECT count(*) FILTER (event_name = 'event_view') / nullif(count(*) FILTER (event_name = 'page_view'), 0)::DOUBLE AS views_per_page, count(*) FILTER (event_name IN ('ticket_click', 'maps_click')) / nullif(count(*) FILTER (event_name = 'event_view'), 0)::DOUBLE AS clicks_per_view FROM v_analytics""")
def product_summary(spark, sf_dir):
    return R.product_summary(view(spark, sf_dir, "v_analytics"))


@query("""SELECT user_id, event_name, ts FROM (SELECT user_id, event_name, strftime(ts, '%Y-%m-%d %H:%M') AS ts FROM v_analytics WHERE event_name <> 'error')""")
def analytics_append(spark, sf_dir):
    a = view(spark, sf_dir, "v_analytics")
    none = F.lit(None).cast("map<string, string>")
    rows = a.select("event_name", F.concat_ws("/", "event_id", "user_id").alias("event_id"), none.alias("metadata"), F.col("ts").cast("timestamp").alias("created_at"))
    good = R.analytics_rows(rows)
    return good.select(F.split_part("event_id", F.lit("/"), F.lit(2)).cast("long").alias("user_id"), "event_name", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("ts"))


USE = "CASE CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 3 WHEN 0 THEN 'allowed' WHEN 1 THEN 'restricted' ELSE 'unknown' END"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 3
    return view(spark, sf_dir, "documents").select(F.col("source").alias("id"), F.when(n == 0, "allowed").when(n == 1, "restricted").otherwise("unknown").alias("commercial_use")).distinct()


@query(f"""WITH s AS (SELECT DISTINCT source, {USE} AS u FROM documents) SELECT source AS source_id, CASE u WHEN 'allowed' THEN 'approved' ELSE 'blocked' END AS status,
  CASE u WHEN 'allowed' THEN 'commercialUse=allowed' WHEN 'restricted' THEN 'commercial/legal approval required' ELSE 'reuse rights not confirmed' END AS reason FROM s""")
def gate_status(spark, sf_dir):
    return R.gate_status(registry(spark, sf_dir))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_id FROM documents WHERE {USE} = 'allowed'")
def gate_filter(spark, sf_dir):
    return R.allowed_rows(view(spark, sf_dir, "v_events").select("id", "source_id"), registry(spark, sf_dir))


# exports


def shaped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, occurrences, venues, refs) with the columns that public rows show."""
    from listwright.functions.text import slug

    c = F.col
    none = F.lit(None).cast("string")
    price = F.when(c("free").isNotNull(), F.struct(c("free"), F.when(~c("free"), c("doc_id") % 90 + 0.5).alias("min"), F.when(~c("free"), c("doc_id") % 90 + 9.5).alias("max"), F.lit("BRL").alias("currency")))
    events = view(spark, sf_dir, "v_events").withColumns({
        "price": price, "slug": F.concat_ws("-", slug(c("title")), "id"), "image_url": none, "ticket_url": F.when(c("doc_id") % 3 == 0, F.lit("https://t.example")), "quality_score": F.lit(0.5), "ranking_score": F.lit(0.5),
    })
    occ = view(spark, sf_dir, "v_occurrences").withColumns({"ends_at": F.lit(None).cast("timestamp"), "status": F.lit("scheduled")})
    venues = view(spark, sf_dir, "v_venues").select("id", "name", none.alias("address"), none.alias("neighborhood"), "city", F.lit("RS").alias("state"), F.lit("BR").alias("country"), "latitude", "longitude")
    refs = view(spark, sf_dir, "v_refs").select("event_id", "source_id", none.alias("external_id"), F.lit("u").alias("url"), "confidence")
    return events, occ, venues, refs


def hydrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested events in the exports' shape."""
    return hydrate(*shaped(spark, sf_dir)).where("occurrences is not null and sources is not null")


OCC1 = "strftime(starts_at, '%Y-%m-%dT%H:%M:%S.000Z')"


@query(f"""WITH o AS (SELECT event_id, string_agg(CASE WHEN temporal_kind = 'timed' THEN '{{"kind":"timed","starts_at":"' || {OCC1} || '","ends_at":null,' ELSE '{{"kind":"date","start_date":"' || start_date || '","end_date":' || coalesce('"' || end_date || '"', 'null') || ',' END || '"timezone":"America/Sao_Paulo","status":"scheduled"}}', '|' ORDER BY id) AS occurrences FROM v_occurrences GROUP BY 1)
  SELECT e.id, e.category_id AS category, o.occurrences, v.name AS venue_name, free, CASE WHEN free = false THEN doc_id % 90 + 0.5e0 END AS price_min, CASE WHEN free IS NOT NULL THEN 'BRL' END AS currency FROM v_events e JOIN o ON o.event_id = e.id LEFT JOIN v_venues v ON v.id = e.venue_id""")
def export_public_rows(spark, sf_dir):
    rows = X.public_rows(hydrated(spark, sf_dir))
    return rows.select("id", "category", F.array_join("occurrences", "|").alias("occurrences"), F.col("venue.name").alias("venue_name"), "free", "price_min", "currency")


@query(f"""WITH {OCC}, m AS (SELECT event_id, min(instant) AS t FROM occ WHERE first_day <= DATE '2024-01-04' AND last_day >= DATE '2024-01-02' GROUP BY 1),
  top AS (SELECT e.*, m.t FROM v_events e JOIN m ON m.event_id = e.id WHERE status = 'scheduled' AND doc_id % 7 <> 0 ORDER BY m.t, e.id LIMIT 12), o AS (SELECT event_id, count(*) AS n FROM v_occurrences GROUP BY 1),
  r AS (SELECT event_id, string_agg(source_id, ',' ORDER BY source_id) AS sources FROM v_refs GROUP BY 1)
  SELECT CAST(row_number() OVER (ORDER BY t, top.id) AS INTEGER) AS pos, top.id, {sql_slug('title')} || '-' || top.id AS slug, category_id AS category, CAST(o.n AS INTEGER) AS occurrences, sources, v.name AS venue_name, free
  FROM top JOIN o ON o.event_id = top.id JOIN r ON r.event_id = top.id LEFT JOIN v_venues v ON v.id = venue_id""")
def discover_public_page(spark, sf_dir):
    """A request's whole way: duplicates hidden, filters, page, children of its rows, public shape."""
    events, occ, venues, refs = shaped(spark, sf_dir)
    rows, _ = D.public_page(events, occ, venues, refs, D.Request(start="2024-01-02", end="2024-01-04", limit=12), events.where("doc_id % 7 = 0"))
    return rows.select("pos", "id", "slug", "category", F.size("occurrences").alias("occurrences"), F.array_join("sources.source_id", ",").alias("sources"), F.col("venue.name").alias("venue_name"), "free")


@query(f"""WITH o AS (SELECT * FROM v_occurrences WHERE id LIKE '%-occ-1')
  SELECT e.id, title AS name, CASE WHEN temporal_kind = 'timed' THEN {OCC1} ELSE CAST(start_date AS VARCHAR) END AS start_date, CASE WHEN status IN ('scheduled', 'cancelled', 'postponed') THEN 'https://schema.org/Event' || upper(substr(status, 1, 1)) || substr(status, 2) END AS event_status,
    v.city AS locality, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN free THEN 0e0 WHEN free = false THEN doc_id % 90 + 0.5e0 END END AS price FROM v_events e JOIN o ON o.event_id = e.id LEFT JOIN v_venues v ON v.id = e.venue_id""")
def export_jsonld(spark, sf_dir):
    rows = X.json_ld(hydrated(spark, sf_dir), "https://agenda.example/")
    shape = "name string, startDate string, eventStatus string, location struct<address: struct<addressLocality: string>>, offers struct<price: double>"
    j = rows.select("id", F.from_json("json", shape).alias("j"))
    return j.select("id", "j.name", F.col("j.startDate").alias("start_date"), F.col("j.eventStatus").alias("event_status"), F.col("j.location.address.addressLocality").alias("locality"), F.col("j.offers.price").alias("price"))


@query(f"""SELECT 'https://agenda.example' AS url, 'hourly' AS change_frequency, 1e0 AS priority UNION ALL
  SELECT 'https://agenda.example/eventos/' || {sql_slug('title')} || '-' || id, 'daily', 0.7e0 FROM v_events WHERE status = 'scheduled'""")
def export_sitemap(spark, sf_dir):
    from listwright.functions.text import slug
    from listwright.operators.discover import full_scan

    visible = full_scan(*(view(spark, sf_dir, n) for n in ("v_events", "v_occurrences", "v_venues")))
    return X.sitemap(visible.withColumn("slug", F.concat_ws("-", slug(F.col("title")), "id")), "https://agenda.example/")


@query("""SELECT id, CASE doc_id % 3 WHEN 0 THEN 'Música' WHEN 1 THEN category_id ELSE 'Exposição' END AS category_label, CASE status WHEN 'cancelled' THEN 'Cancelado' WHEN 'postponed' THEN 'Adiado' END AS status_label, CASE doc_id % 2 WHEN 0 THEN 'Curadoria Agenda' ELSE source_id END AS source_label FROM v_events""")
def label_enrichment(spark, sf_dir):
    d = F.col("doc_id")
    category = F.when(d % 3 == 0, "music").when(d % 3 == 1, F.col("category_id")).otherwise("exposicao")
    source = F.when(d % 2 == 0, "manual-beta").otherwise(F.col("source_id"))
    return view(spark, sf_dir, "v_events").select("id", X.category_label(category).alias("category_label"), X.status_label(F.col("status")).alias("status_label"), X.source_label(source, BRAND).alias("source_label"))


MONTH = "['jan', 'fev', 'mar', 'abr', 'mai', 'jun', 'jul', 'ago', 'set', 'out', 'nov', 'dez'][month({0})]"


@query(f"""WITH {OCC}, l AS (SELECT *, (starts_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS t FROM occ)
  SELECT id, CASE WHEN temporal_kind = 'timed' THEN day(t) || ' ' || {MONTH.format('t')} || ' · ' || hour(t) || 'h' || CASE WHEN minute(t) = 0 THEN '' ELSE lpad(CAST(minute(t) AS VARCHAR), 2, '0') END
    WHEN end_date IS NULL OR end_date = start_date THEN day(start_date) || ' ' || {MONTH.format('start_date')} ELSE day(start_date) || '–' || day(end_date) || ' ' || {MONTH.format('end_date')} END AS occurrence_text FROM l""")
def display_occurrences(spark, sf_dir):
    c = F.col
    return view(spark, sf_dir, "v_occurrences").select("id", X.occurrence_text(c("temporal_kind"), c("starts_at"), c("start_date"), c("end_date")).alias("occurrence_text"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Grátis' WHEN p_partkey % 5 = 0 THEN NULL ELSE 'R$' || chr(160) || replace(replace(replace(format('{:,.2f}', p_retailprice), ',', ';'), '.', ','), ';', '.') END AS price_text,
  CASE WHEN p_size < 10 THEN CAST(p_size * 100 AS VARCHAR) || ' m' ELSE replace(format('{:.1f}', p_size / 10e0), '.', ',') || ' km' END AS distance_text FROM part""")
def display_prices(spark, sf_dir):
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    low = F.when(k % 5 != 0, price)
    return view(spark, sf_dir, "part").select("p_partkey", X.price_text(k % 7 == 0, low, low, F.lit("BRL")).alias("price_text"), X.distance_text(F.col("p_size") * 100.0).alias("distance_text"))


@query("SELECT count(*) AS n, min(latitude) AS south, min(longitude) AS west, max(latitude) AS north, max(longitude) AS east FROM v_events e JOIN v_venues v ON v.id = e.venue_id WHERE latitude IS NOT NULL AND longitude IS NOT NULL")
def map_extent(spark, sf_dir):
    places = view(spark, sf_dir, "v_venues").select(F.col("id").alias("venue_id"), "latitude", "longitude")
    return X.map_extent(view(spark, sf_dir, "v_events").join(places, "venue_id"))


