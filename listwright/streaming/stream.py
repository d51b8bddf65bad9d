"""Structured Streaming twins of the incremental operators: landed feed files, and analytics rows appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from listwright.operators import buckets
from listwright.operators.reports import analytics_rows, validated_analytics
from listwright.operators.spec import changed_only
from listwright.operators.store import upsert_raw

ANALYTICS_SCHEMA = "event_name string, event_id string, metadata map<string, string>, created_at timestamp"


def feed_stream(spark: SparkSession, folder: str, schema: str, path: str = "events") -> DataFrame:
    """Rows of the feed documents that land in a folder; each file is read once, as the checkpoint remembers."""
    return spark.readStream.schema(schema).option("multiLine", True).json(folder).select(F.explode(path).alias("e")).select("e.*")


def ingest(stream: DataFrame, normalize: Callable[[DataFrame], DataFrame], good: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Normalizes what has landed since the last run and ends; good rows and rejects go to two tables."""

    def batch(rows: DataFrame, number: int) -> None:
        done = normalize(rows).withColumn("batch", F.lit(number))
        # a batch that is repeated after a failure overwrites its own partition
        for part, path in ((done.where("reason is null"), good), (done.where("reason is not null").select("source_id", "external_id", "title", "reason", "batch"), rejected)):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def analytics_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(ANALYTICS_SCHEMA).json(folder)


def append_analytics(stream: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Good rows. The checkpoint and the sink's log make a file's rows count once; rows that carry a request_id are also
    kept apart from those that a client sends again within the watermark."""
    rows = analytics_rows(stream)
    if "request_id" in stream.columns:
        rows = rows.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def rejected_analytics(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    rows = validated_analytics(stream).where("reason is not null")
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, event_name, n) in event time."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", width), "event_name").agg(F.count("*").alias("n"))


# tables that streams keep up to date: each batch is one upsert of the buckets it touches

COUNTS_SCHEMA, COUNTS_KEYS = "day date, event_name string, n bigint, batch bigint", ["day", "event_name"]


def day_counts(changes: DataFrame) -> DataFrame:
    """(day, event_name, n) of change rows: sign is 1 for an event, -1 for one that is taken back."""
    return changes.groupBy(F.to_date("created_at").alias("day"), "event_name").agg(F.sum("sign").cast("long").alias("n"))


def added_once(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts plus a batch's counts. What a key has of this batch, or a later one, is in it already: a batch that is
    repeated after a failure changes nothing."""
    rows = old.join(new.select(*COUNTS_KEYS, F.col("n").alias("more"), F.col("batch").alias("number")), COUNTS_KEYS, "full_outer")
    due = F.col("number").isNotNull() & (F.col("batch").isNull() | (F.col("batch") < F.col("number")))
    return rows.select(*COUNTS_KEYS, F.when(due, F.coalesce("n", F.lit(0)) + F.col("more")).otherwise(F.col("n")).alias("n"), F.when(due, F.col("number")).otherwise(F.col("batch")).alias("batch"))


def keep_counts(changes: DataFrame, path: str, checkpoint: str, late: str = "1 hour", parts: int = 16) -> StreamingQuery:
    """Keeps the table of `day_counts` at `path` up to date, whatever day a row is of; rows that carry a request_id are kept
    apart from those sent again within the watermark. A table belongs to one checkpoint."""
    spark = changes.sparkSession
    if buckets.latest(spark, path) is None:
        buckets.create(spark, path, COUNTS_SCHEMA, COUNTS_KEYS, parts)
    if "request_id" in changes.columns:
        changes = changes.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["request_id", "sign"])

    def batch(rows: DataFrame, number: int) -> None:
        buckets.upsert(spark, path, day_counts(rows).withColumn("batch", F.lit(number).cast("long")), added_once)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RAW_SCHEMA = """id string, source_id string, external_id string, source_url string, payload string, content_hash string, fetched_at timestamp,
  schema_version int, processing_status string, processing_error string"""


def keep_raw(envelopes: DataFrame, path: str, loose: str, checkpoint: str, parts: int = 16) -> StreamingQuery:
    """Keeps the raw table at `path` up to date with envelopes as `feeds` makes them: a payload whose hash is the stored one
    leaves its row, and what was made of it, as it is; another one is pending again. Rows without an external id go to
    the folder `loose`, each batch to a partition of its own, which it overwrites if it is repeated."""
    spark = envelopes.sparkSession
    if buckets.latest(spark, path) is None:
        buckets.create(spark, path, RAW_SCHEMA, ["source_id", "external_id"], parts)

    def batch(rows: DataFrame, number: int) -> None:
        known = rows.where("external_id is not null")
        buckets.upsert(spark, path, known, lambda old, new: upsert_raw(old, changed_only(old, new)))
        rest = rows.where("external_id is null").withColumn("batch", F.lit(number))
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(loose)

    return envelopes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def high_water(raw: DataFrame) -> DataFrame:
    """(source_id, fetched_at) of the newest stored row of each source: where the next collection goes on."""
    return raw.groupBy("source_id").agg(F.max("fetched_at").alias("fetched_at"))
