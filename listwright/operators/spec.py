"""Operators that the specification documents describe without code: each is marked as from the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the quality score (they sum to 1) and of the ranking score.
QUALITY_WEIGHTS = {"title": 0.15, "date": 0.20, "venue": 0.15, "geo": 0.10, "description": 0.10, "price": 0.05, "image": 0.05, "official_source": 0.10, "multiple_sources": 0.10}
RANKING_WEIGHTS = {"freshness": 0.30, "quality": 0.30, "source_confidence": 0.20, "proximity": 0.20}


def quality_score(has: dict[str, Column]) -> Column:
    """From the document: the weights of what an event has; `has` maps factors to booleans."""
    return sum((F.coalesce(has[k], F.lit(False)).cast("int") * w for k, w in QUALITY_WEIGHTS.items() if k in has), F.lit(0.0))


def ranking_score(parts: dict[str, Column]) -> Column:
    """From the document; the parts' own formulas are the caller's. A missing part counts as 0."""
    return sum((F.coalesce(parts[k], F.lit(0.0)) * w for k, w in RANKING_WEIGHTS.items() if k in parts), F.lit(0.0))


def deterministic_pairs(rows: DataFrame, keys: list[list[str]]) -> DataFrame:
    """From the document: (left_id, right_id) of rows equal in all columns of one of `keys`.

    Each row is paired with the smallest id of its key, so a key that many rows share gives a star of pairs, not all.
    """
    out = None
    for key in keys:
        there = rows.dropna(subset=key)
        least = there.groupBy(*key).agg(F.min("id").alias("left_id"), F.count("*").alias("n")).where("n > 1").drop("n")
        own = there.join(least, key).where(F.col("id") != F.col("left_id")).select("left_id", F.col("id").alias("right_id"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def data_metrics(raw: DataFrame, events: DataFrame) -> DataFrame:
    """From the document: by source, ingested and failed records, events without venue, place, price or image."""
    a = raw.groupBy("source_id").agg(F.count("*").alias("ingested"), F.count_if(F.col("processing_status") == "failed").alias("failed"))
    missing = {"no_venue": "venue_id", "no_geo": "latitude", "no_price": "free", "no_image": "image_url"}
    b = events.groupBy("source_id").agg(*(F.count_if(F.col(c).isNull()).alias(k) for k, c in missing.items() if c in events.columns))
    return a.join(b, "source_id", "full_outer").na.fill(0)


def retention(raw: DataFrame, now: Column) -> DataFrame:
    """From the document: `retention` is expired, kept or, without a date, undecided (which isn't forever)."""
    until = F.col("retention_until")
    return raw.withColumn("retention", F.when(until.isNull(), "undecided").when(until <= now, "expired").otherwise("kept"))


def change_log(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """From the document: (key, field, previous, current) of re-ingested rows whose values differ; null is a value."""
    x = new.select(key, *(F.col(c).cast("string").alias(f"n_{c}") for c in columns))
    y = old.select(key, *(F.col(c).cast("string").alias(f"o_{c}") for c in columns))
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("previous"), F.col(f"n_{c}").alias("current")) for c in columns))
    return y.join(x, key).select(key, F.explode(F.filter(cells, lambda c: ~c["previous"].eqNullSafe(c["current"]))).alias("c")).select(key, "c.*")


def changed_only(old: DataFrame, batch: DataFrame) -> DataFrame:
    """From the document: batch rows whose content hash isn't the stored one's; new keys and null keys pass."""
    known = old.select("source_id", "external_id", F.col("content_hash").alias("_hash"))
    rows = batch.join(known, ["source_id", "external_id"], "left")
    return rows.where(~F.col("_hash").eqNullSafe(F.col("content_hash")) | F.col("_hash").isNull()).select(*batch.columns)
