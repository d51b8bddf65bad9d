"""Feed scans (nested JSON documents to one row per listing), raw envelopes, registry, labelled pairs, page probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions.text import blank_to_null, external_id_of

TICKET_SCHEMA = """_embedded struct<events: array<struct<
  id: string, name: string, url: string, info: string,
  images: array<struct<url: string, ratio: string, width: int, height: int>>,
  dates: struct<start: struct<localDate: string, localTime: string, dateTime: string>, status: struct<code: string>>,
  classifications: array<struct<primary: boolean, segment: struct<name: string>, genre: struct<name: string>>>,
  priceRanges: array<struct<type: string, currency: string, min: double, max: double>>,
  _embedded: struct<
    venues: array<struct<id: string, name: string, city: struct<name: string>, state: struct<stateCode: string>,
      country: struct<countryCode: string>, address: struct<line1: string>, location: struct<latitude: string, longitude: string>>>,
    attractions: array<struct<id: string, name: string>>>>>>"""
AGENDA_FIELDS = """id: string, title: string, url: string, description: string, startDate: string, endDate: string,
  startTime: string, endTime: string, venueName: string, address: string, neighborhood: string, categories: array<string>,
  free: boolean, priceValue: double, imageUrl: string, externalUrl: string"""
CURATED_FIELDS = """id: string, title: string, description: string, startDate: string, endDate: string, startTime: string,
  endTime: string, venueName: string, address: string, neighborhood: string, latitude: double, longitude: double,
  categories: array<string>, free: boolean, priceValue: double, sourceUrl: string, ticketUrl: string, imageUrl: string,
  imageRightsConfirmed: boolean"""
SIDE = """struct<id: string, slug: string, title: string, description: string, categoryId: string, subcategories: array<string>,
  status: string, occurrence: struct<kind: string, startsAt: timestamp, endsAt: timestamp, startDate: date, endDate: date>,
  venue: struct<id: string, name: string, address: string, neighborhood: string, city: string, state: string, latitude: double, longitude: double>,
  performers: array<struct<id: string, name: string>>, price: struct<free: boolean, min: double, max: double>,
  imageUrl: string, ticketUrl: string, canonicalUrl: string, source: struct<sourceId: string, externalId: string, url: string, confidence: double>>"""
PAIR_FIELDS = f"""id: string, description: string, left: {SIDE}, right: {SIDE}, identityTruth: string, expectedRouting: string,
  criticalConflicts: array<string>, rationale: string, tags: array<string>, difficulty: string"""

# The four registered sources.
SOURCES = [
    ("ticketmaster", "Ticketmaster Discovery API", "api", True, 60, 0.7, "restricted"),
    ("destino-poa", "Destino POA — Agenda Cultural", "crawler", True, 240, 0.75, "unknown"),
    ("manual-beta", "Manual (Beta Curated Events)", "manual", True, 1440, 0.6, "allowed"),
    ("ui-demo", "UI Demo Dataset (development/demo only)", "manual", True, 1440, 0.0, "restricted"),
]
# What stands for a record without a URL of its own.
TICKET_EVENT_URL, TICKET_API_URL = "https://www.ticketmaster.com/event/", "https://app.ticketmaster.com/discovery/v2/events.json"
AGENDA_URL, AGENDA_EVENT_URL = "https://destinopoa.com.br/agenda/", "https://destinopoa.com.br/evento/"
TICKET, AGENDA, CURATED, DEMO = (x[0] for x in SOURCES)


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def ticket_feed(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark, path, TICKET_SCHEMA).select(F.explode("_embedded.events").alias("e")).select("e.*")


def agenda_feed(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark, path, f"events array<struct<{AGENDA_FIELDS}>>").select(F.explode("events").alias("e")).select("e.*")


def curated_feed(spark: SparkSession, path: str) -> DataFrame:
    return documents(spark, path, f"events array<struct<{CURATED_FIELDS}>>").select(F.explode("events").alias("e")).select("e.*")


def demo_feed(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """The curated feed; image paths from the root get the base URL."""
    rooted = F.when(F.startswith("imageUrl", F.lit("/")), F.concat(F.lit(base_url.rstrip("/")), F.col("imageUrl"))).otherwise(F.col("imageUrl"))
    return curated_feed(spark, path).withColumn("imageUrl", rooted)


def content_hash(payload: Column) -> Column:
    """SHA-256 of a JSON text, whatever the order of its keys."""
    return F.sha2(F.to_json(F.parse_json(payload)), 256)


def raw_envelope(feed: DataFrame, source_id: str, external_id: Column, source_url: Column, fetched_at: Column) -> DataFrame:
    payload = F.to_json(F.struct(*feed.columns))
    return feed.select(
        F.expr("uuid()").alias("id"),
        F.lit(source_id).alias("source_id"),
        external_id.alias("external_id"),
        source_url.alias("source_url"),
        payload.alias("payload"),
        content_hash(payload).alias("content_hash"),
        fetched_at.cast("timestamp").alias("fetched_at"),
        F.lit(1).alias("schema_version"),
    )


def ticket_raw(feed: DataFrame, fetched_at: Column, source_id: str = TICKET) -> DataFrame:
    own = blank_to_null(F.col("id"))
    return raw_envelope(feed, source_id, own, F.coalesce(F.col("url"), F.concat(F.lit(TICKET_EVENT_URL), own), F.lit(TICKET_API_URL)), fetched_at)


def agenda_raw(feed: DataFrame, fetched_at: Column, source_id: str = AGENDA) -> DataFrame:
    return raw_envelope(feed, source_id, external_id_of(F.col("id"), F.col("url")), F.coalesce(F.col("url"), F.lit(AGENDA_URL)), fetched_at)


def curated_raw(feed: DataFrame, fetched_at: Column, source_id: str = CURATED) -> DataFrame:
    return raw_envelope(feed, source_id, blank_to_null(F.col("id")), F.coalesce(F.col("sourceUrl"), F.lit("")), fetched_at)


def source_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "id string, name string, type string, enabled boolean, polling_interval_minutes int, authority_score double, commercial_use string")


def registered(registry: DataFrame, source_id: str) -> DataFrame:
    return registry.where(F.col("id") == source_id)


def since(rows: DataFrame, column: str, lower: Column | None) -> DataFrame:
    """Rows from an instant on; all of them without one."""
    return rows if lower is None else rows.where(F.col(column) >= lower)


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """One row per case with two nested events, defaults filled in."""
    # The cases' defaults.
    city, state, confidence, at = "Porto Alegre", "RS", 0.8, "2026-01-01T00:00:00Z"

    def filled(c: str) -> Column:
        side = F.col(c)
        venue = F.when(side["venue"].isNotNull(), side["venue"].withField("city", F.coalesce(side["venue"]["city"], F.lit(city))).withField("state", F.coalesce(side["venue"]["state"], F.lit(state))))
        source = side["source"].withField("confidence", F.coalesce(side["source"]["confidence"], F.lit(confidence)))
        return side.withField("venue", venue).withField("source", source).withField("status", F.coalesce(side["status"], F.lit("scheduled"))).withField("seenAt", F.lit(at).cast("timestamp"))

    rows = documents(spark, path, f"version int, description string, cases array<struct<{PAIR_FIELDS}>>").select(F.explode("cases").alias("c")).select("c.*")
    return rows.withColumn("left", filled("left")).withColumn("right", filled("right"))


def page_structure(pages: DataFrame, link_pattern: str = r'href="(https://destinopoa\.com\.br/evento/[^"?#]+/?)"') -> DataFrame:
    """page_id, structured_data, event_links and strategy of each page: json-ld before html before unknown."""
    html = F.coalesce(F.col("html"), F.lit(""))
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    structured = F.exists(blocks, lambda b: b.rlike(r'(?i)"@type"\s*:\s*"Event"'))
    links = F.size(F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)" + link_pattern), F.lit(1))))
    strategy = F.when(structured, "json-ld").when(links > 0, "html").otherwise("unknown")
    return pages.select("page_id", structured.alias("structured_data"), links.cast("long").alias("event_links"), strategy.alias("strategy"))
