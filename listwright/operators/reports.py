"""Operational and product reports, analytics validation, source gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event names, metadata keys and bounds of analytics rows; gate decisions by commercial use.
EVENT_NAMES = ["page_view", "event_view", "search", "filter_used", "nearby_used", "map_opened", "share", "ticket_click", "maps_click"]
METADATA_KEYS, MOST_ID, MOST_VALUE = ["period", "category", "free"], 200, 64
GATES = {"allowed": ("approved", "commercialUse=allowed"), "restricted": ("blocked", "commercial/legal approval required"), "unknown": ("blocked", "reuse rights not confirmed")}
DEDUP_STATUSES = ["pending_review", "auto_approved", "confirmed_same", "confirmed_different"]


def ops_counts(events: DataFrame, raw: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row; each table is counted once, and single rows are put side by side."""
    e = events.agg(F.count("*").alias("events"))
    r = raw.agg(*(F.count_if(F.col("processing_status") == s).alias(f"raw_{s}") for s in ("pending", "failed")))
    d = candidates.agg(*(F.count_if(F.col("status") == s).alias(f"dedup_{s}") for s in DEDUP_STATUSES))
    return e.crossJoin(r).crossJoin(d)


def source_health(sources: DataFrame, raw: DataFrame, refs: DataFrame) -> DataFrame:
    """Each source, also those without rows: last fetch, processed counts, distinct events."""
    by_raw = raw.groupBy("source_id").agg(F.max("fetched_at").alias("last_fetched_at"), *(F.count_if(F.col("processing_status") == s).alias(f"raw_{s}") for s in ("normalized", "failed")))
    by_ref = refs.groupBy("source_id").agg(F.count_distinct("event_id").alias("events"))
    rows = sources.select(F.col("id").alias("source_id")).join(by_raw, "source_id", "left").join(by_ref, "source_id", "left")
    return rows.select("source_id", "last_fetched_at", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("raw_normalized", "raw_failed", "events")))


def analytics_error(name: Column, event_id: Column, metadata: Column) -> Column:
    """First reason against a row; metadata is map<string, variant or string>, keys of objects in order. Null is good."""
    keys = F.map_keys(metadata)
    bad_key = F.try_element_at(F.filter(keys, lambda k: ~k.isin(METADATA_KEYS)), F.lit(1))
    long_value = F.try_element_at(F.filter(F.map_entries(metadata), lambda e: F.char_length(e["value"]) > MOST_VALUE), F.lit(1))["key"]
    compound = F.try_element_at(F.filter(F.map_entries(metadata), lambda e: e["value"].isNull() | e["value"].rlike(r"^\s*[\[{]")), F.lit(1))["key"]
    return (
        F.when(name.isNull() | ~name.isin(EVENT_NAMES), "unknown event_name")
        .when((event_id == "") | (F.char_length(event_id) > MOST_ID), "bad event_id")
        .when(bad_key.isNotNull(), F.concat(F.lit("metadata key not allowed: "), bad_key))
        .when(compound.isNotNull(), F.concat(F.lit("metadata value not a scalar: "), compound))
        .when(long_value.isNotNull(), F.concat(F.lit("metadata value too long: "), long_value))
    )


def validated_analytics(rows: DataFrame) -> DataFrame:
    """rows: event_name, event_id, metadata map<string, string>; adds `reason`."""
    return rows.withColumn("reason", analytics_error(F.col("event_name"), F.col("event_id"), F.col("metadata")))


def analytics_rows(rows: DataFrame) -> DataFrame:
    """Good rows, each with an id: the request_id it comes with, else a new one. Equal clicks of one instant stay two rows."""
    good = validated_analytics(rows).where("reason is null").drop("reason")
    own = F.coalesce("request_id", F.uuid()) if "request_id" in rows.columns else F.uuid()
    return good.select(own.alias("id"), "event_name", "event_id", "metadata", "created_at")


def product_counts(rows: DataFrame) -> DataFrame:
    """(event_name, n) of all nine names, zeros included, other names ignored."""
    names = rows.sparkSession.createDataFrame([(n,) for n in EVENT_NAMES], "event_name string")
    counted = rows.where(F.col("event_name").isin(EVENT_NAMES)).groupBy("event_name").agg(F.count("*").alias("n"))
    return names.join(counted, "event_name", "left").select("event_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def product_summary(rows: DataFrame) -> DataFrame:
    n = lambda *names: F.count_if(F.col("event_name").isin(*names))
    return rows.agg(F.try_divide(n("event_view"), n("page_view")).alias("views_per_page"), F.try_divide(n("ticket_click", "maps_click"), n("event_view")).alias("clicks_per_view"))


def gate_status(registry: DataFrame) -> DataFrame:
    use = F.col("commercial_use")
    pick = lambda i: F.create_map(*(x for k, v in GATES.items() for x in (F.lit(k), F.lit(v[i]))))[use]
    return registry.select(F.col("id").alias("source_id"), pick(0).alias("status"), pick(1).alias("reason"))


def allowed_rows(rows: DataFrame, registry: DataFrame, production: bool = True) -> DataFrame:
    """In production, rows of blocked or unknown sources don't pass."""
    if not production:
        return rows
    open_ = gate_status(registry).where("status = 'approved'").select("source_id")
    return rows.join(open_, "source_id", "left_semi")
