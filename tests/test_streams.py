"""Streams that keep tables up to date, against the batch queries; restarts, repeats, late and retracted rows."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from listwright.operators import buckets
from listwright.operators import store as S
from listwright.streaming import stream

CHANGES = "event_name string, created_at timestamp, sign int, request_id string"


def lines(path, rows):
    path.write_text("\n".join(map(json.dumps, rows)))


def change(name, at, sign=1, request=None):
    return {"event_name": name, "created_at": f"2026-01-{at}Z", "sign": sign, "request_id": request or f"{name}{at}{sign}"}


def test_counts_are_those_of_the_batch_query(spark, tmp_path):
    folder, path, check = tmp_path / "in", str(tmp_path / "counts"), str(tmp_path / "check")
    folder.mkdir()
    parts = [
        [change("share", "05T10:00:00"), change("share", "05T10:01:00"), change("search", "05T10:02:00"), change("share", "05T10:00:00")],
        [change("share", "05T10:03:00"), change("share", "05T10:01:00", -1), change("search", "04T23:59:59"), change("search", "06T00:00:00")],
        [change("share", "05T10:04:00"), change("search", "06T00:00:00"), change("search", "05T23:30:00", -1)],
    ]
    source = spark.readStream.schema(CHANGES).json(str(folder))
    sent = []
    for i, rows in enumerate(parts):
        lines(folder / f"{i}.json", rows)
        stream.keep_counts(source, path, check, "30 days").awaitTermination()  # a restart each time
        sent += rows
        seen = {(r["request_id"], r["sign"]): r for r in sent}.values()
        plain = spark.createDataFrame([(r["event_name"], r["created_at"], r["sign"]) for r in seen], "event_name string, at string, sign int").withColumn("created_at", F.col("at").cast("timestamp"))
        want = sorted((str(r["day"]), r["event_name"], r["n"]) for r in stream.day_counts(plain).collect())
        assert sorted((str(r["day"]), r["event_name"], r["n"]) for r in buckets.read(spark, path).collect()) == want
    assert ("2026-01-05", "share", 3) in want and ("2026-01-05", "search", 0) in want
    again = stream.day_counts(plain).withColumn("batch", F.lit(2).cast("long"))  # the last batch once more
    assert buckets.upsert(spark, path, again.where("event_name = 'share'"), stream.added_once) == []


def test_counts_by_window_and_rejects(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"event_name": n, "created_at": f"2026-01-01T00:0{m}:00Z"} for n, m in (("share", 1), ("share", 4), ("share", 6), ("search", 6), ("nope", 2))]
    lines(folder / "1.json", rows)
    source = stream.analytics_stream(spark, str(folder))
    stream.rejected_analytics(source, str(tmp_path / "bad"), str(tmp_path / "c1")).awaitTermination()
    assert [(r["event_name"], r["reason"]) for r in spark.read.json(str(tmp_path / "bad")).collect()] == [("nope", "unknown event_name")]
    query = stream.counts_by_window(source).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["window"]["start"].minute, r["event_name"]): r["n"] for r in spark.table("windows").collect()}
    assert got == {(0, "share"): 2, (5, "share"): 1, (5, "search"): 1, (0, "nope"): 1}


def envelope(key, payload, at, source="a"):
    return {"id": f"{source}{key}{at}", "source_id": source, "external_id": key, "payload": payload, "content_hash": payload, "fetched_at": f"2026-01-0{at}T00:00:00Z", "schema_version": 1}


def test_intake_skips_what_is_unchanged(spark, tmp_path):
    folder, path, loose, check = tmp_path / "in", str(tmp_path / "raw"), str(tmp_path / "loose"), str(tmp_path / "check")
    folder.mkdir()
    envelopes = ", ".join(x for x in stream.RAW_SCHEMA.replace("\n", " ").split(", ") if "processing" not in x)
    source = spark.readStream.schema(envelopes).json(str(folder))
    rows = [envelope("1", "x", 1), envelope("2", "y", 1), envelope("1", "x2", 2), envelope(None, "z", 1), envelope("1", "q", 1, "b")]
    lines(folder / "1.json", rows)
    stream.keep_raw(source, path, loose, check).awaitTermination()
    table = lambda: {(r["source_id"], r["external_id"]): (r["id"], r["payload"], r["processing_status"]) for r in buckets.read(spark, path).collect()}
    assert table() == {("a", "1"): ("a12", "x2", "pending"), ("a", "2"): ("a21", "y", "pending"), ("b", "1"): ("b11", "q", "pending")}
    done = buckets.read(spark, path).select("source_id", "external_id", F.lit("normalized").alias("status"), F.lit(None).cast("string").alias("error"))
    buckets.upsert(spark, path, done, S.mark_processed)
    lines(folder / "2.json", [envelope("1", "x2", 3), envelope("2", "y2", 3), envelope("3", "n", 3), envelope(None, "z", 3)])
    for _ in range(2):  # a second start finds nothing new
        stream.keep_raw(source, path, loose, check).awaitTermination()
    assert table() == {("a", "1"): ("a12", "x2", "normalized"), ("a", "2"): ("a21", "y2", "pending"), ("b", "1"): ("b11", "q", "normalized"), ("a", "3"): ("a33", "n", "pending")}
    assert spark.read.parquet(loose).count() == 2
    marks = {r["source_id"]: r["fetched_at"] for r in stream.high_water(buckets.read(spark, path)).collect()}
    assert {k: v.astimezone(timezone.utc).replace(tzinfo=None) for k, v in marks.items()} == {"a": datetime(2026, 1, 3), "b": datetime(2026, 1, 1)}
