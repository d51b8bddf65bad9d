"""What stored tables do to files: upserts that rewrite touched buckets only, date ranges that open few files."""

import os
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from listwright.operators import buckets, discover
from listwright.operators import store as S

SCHEMA = "k string, part string, v bigint, tags array<string>, first_seen string"
KEYS = ["k", "part"]


def merge(old, new):
    return S.upsert(old, new, KEYS, keep=["first_seen"])


def batch(spark, rows):
    return spark.createDataFrame([(k, p, v, [k], seen) for k, p, v, seen in rows], SCHEMA)


def files_of(path):
    return {str(f): (f.stat().st_mtime_ns, f.stat().st_size) for f in Path(path).rglob("*.parquet")}


def rows_of(spark, path):
    return sorted(((r["k"], r["part"], r["v"], r["first_seen"]) for r in buckets.read(spark, path).collect()), key=repr)


def test_upsert_of_few_keys_leaves_other_buckets(spark, tmp_path):
    path = str(tmp_path / "state")
    buckets.create(spark, path, SCHEMA, KEYS, 64)
    assert buckets.read(spark, path).count() == 0
    first = [(f"k{i}", "a", i, "one") for i in range(1000)] + [(None, "a", 5, "one")]
    changed = buckets.upsert(spark, path, batch(spark, first), merge)
    assert len(changed) > 50 and rows_of(spark, path) == sorted(first, key=repr)
    before = files_of(path)
    held = buckets.latest(spark, path)["folders"]
    few = [(f"k{i}", "a", -i, "two") for i in range(0, 1000, 100)] + [("new", "b", 1, "two")]
    changed = buckets.upsert(spark, path, batch(spark, few), merge)
    assert 0 < len(changed) <= 11
    want = {(k, p): (v, s) for k, p, v, s in first} | {(k, p): (v, "one" if k != "new" else "two") for k, p, v, s in few}
    assert rows_of(spark, path) == sorted(((k, p, v, s) for (k, p), (v, s) in want.items()), key=repr)
    assert all(files_of(path)[f] == x for f, x in before.items())
    after = buckets.latest(spark, path)["folders"]
    assert {b for b in held if after[b] != held[b]} <= {str(b) for b in changed}
    assert len(held) - sum(after[b] == held[b] for b in held) <= 11

    # again: no bucket changes, no manifest is written, and what the attempt wrote can be cleared
    assert buckets.upsert(spark, path, batch(spark, few), merge) == []
    assert buckets.latest(spark, path)["folders"] == after and len(list(Path(path).glob("manifests/*.json"))) == 3
    assert buckets.upsert(spark, path, batch(spark, []), merge) == []
    rows = rows_of(spark, path)
    assert buckets.vacuum(spark, path) > 0
    assert rows_of(spark, path) == rows and len(list(Path(path).glob("manifests/*.json"))) == 1
    assert {str(Path(f).parent.relative_to(path)) for f in files_of(path)} == set(after.values())


def test_two_upserts_at_a_time_dont_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "state")
    buckets.create(spark, path, SCHEMA, KEYS, 4)

    def while_another_writes(old, new):
        buckets.upsert(spark, path, batch(spark, [("x", "a", 1, "one")]), merge)
        return merge(old, new)

    with pytest.raises(RuntimeError, match="another upsert"):
        buckets.upsert(spark, path, batch(spark, [("y", "a", 2, "two")]), while_another_writes)
    assert rows_of(spark, path) == [("x", "a", 1, "one")]
    buckets.upsert(spark, path, batch(spark, [("y", "a", 2, "two")]), merge)
    assert len(rows_of(spark, path)) == 2


def test_rows_may_leave_but_not_move(spark, tmp_path):
    path = str(tmp_path / "state")
    buckets.create(spark, path, SCHEMA, KEYS, 8)
    buckets.upsert(spark, path, batch(spark, [(f"k{i}", "a", i, "one") for i in range(30)]), merge)
    gone = batch(spark, [("k3", "a", 0, "")])
    buckets.upsert(spark, path, gone, lambda old, new: old.join(new.select("k"), "k", "left_anti").select(*old.columns))
    assert len(rows_of(spark, path)) == 29
    with pytest.raises(ValueError, match="moved"):
        buckets.upsert(spark, path, gone, lambda old, new: new.unionByName(new.withColumn("k", F.explode(F.array(*(F.lit(f"z{i}") for i in range(40)))))))
    assert len(rows_of(spark, path)) == 29
    with pytest.raises(FileNotFoundError):
        buckets.upsert(spark, str(tmp_path / "none"), gone, merge)


def occurrences(spark):
    rows, base = [], datetime(2025, 1, 1)
    for i in range(700):
        at = base + timedelta(hours=13 * i)
        if i % 3 == 0:
            rows.append((f"o{i}", f"e{i % 500}", "date", None, None, at.date(), at.date() + timedelta(days=[0, 3, 60][i % 9 // 3]) if i % 2 else None))
        else:
            rows.append((f"o{i}", f"e{i % 500}", "timed", at, at + timedelta(hours=i % 30) if i % 5 else None, None, None))
    return spark.createDataFrame(rows, "id string, event_id string, temporal_kind string, starts_at timestamp, ends_at timestamp, start_date date, end_date date")


def test_date_ranges_open_few_files(spark, tmp_path):
    path = str(tmp_path / "occurrences")
    plain = occurrences(spark)
    S.write_occurrences(plain, path)
    stored = spark.read.parquet(path)
    assert sorted(r["id"] for r in stored.select("id").collect()) == sorted(r["id"] for r in plain.select("id").collect())
    for start, days in ((date(2025, 1, 1), 0), (date(2025, 3, 9), 0), (date(2025, 6, 30), 6), (date(2025, 12, 31), 20), (date(2024, 1, 1), 3)):
        span = F.lit(start), F.lit(start + timedelta(days=days))
        rows = discover.matching(stored, *span)
        want = sorted((r["event_id"], r["sort_instant"]) for r in discover.matching(plain, *span).collect())
        assert sorted((r["event_id"], r["sort_instant"]) for r in rows.collect()) == want
    rows = discover.matching(stored, F.lit("2025-03-09").cast("date"), F.lit("2025-03-10").cast("date"))
    assert rows.count() > 0
    plan = rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "LessThanOrEqual(utc_first," in plan and "GreaterThanOrEqual(utc_last," in plan and "utc_week" in plan.split("PartitionFilters: ")[1].split("]")[0]
    opened = {r["f"] for r in stored.where(S.in_clustered_range(F.lit("2025-03-09").cast("date"), F.lit("2025-03-10").cast("date"))).select(F.input_file_name().alias("f")).collect()}
    every = [f for f in Path(path).rglob("*.parquet") if "lasting=false" in str(f)]
    weeks = {os.path.dirname(f).rpartition("utc_week=")[2] for f in opened if "lasting=false" in f}
    assert len(weeks) <= 3 < len({f.parent for f in every}) // 10


def test_nearest_places(spark, tmp_path):
    """As a sort of all distances, also at the date line and the poles; the box reaches the scan and few files have it."""
    import numpy as np

    draw = np.random.default_rng(2)
    rows = [(i, float(np.degrees(np.arcsin(draw.uniform(-1, 1)))), float(draw.uniform(-180, 180))) for i in range(3000)]
    rows += [(3000 + i, float(draw.normal(-30, 0.01)), float(draw.normal(-51.2, 0.01))) for i in range(300)]
    rows += [(3300 + i, float(draw.normal(0, 0.5)), float((180 + draw.normal(0, 0.5) + 180) % 360 - 180)) for i in range(300)]
    rows += [(3600 + i, 90.0 - abs(float(draw.normal(0, 0.3))), float(draw.uniform(-180, 180))) for i in range(200)]
    rows += [(3900, -30.0, -51.2), (3901, -30.0, -51.2), (3902, None, 1.0), (3903, 1.0, None), (3904, 90.0, 0.0), (3905, -90.0, 180.0), (3906, 0.0, 180.0), (3907, 0.0, -180.0)]
    plain = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    path = str(tmp_path / "places")
    discover.write_places(plain, path)
    places = spark.read.parquet(path)
    c = F.col
    for lat, lng, k in ((-30.0, -51.2, 5), (-30.0, -51.2, 250), (0.0, 179.99, 40), (0.1, -179.999, 40), (89.99, 10.0, 60), (-89.9, 0.0, 7), (10.0, 10.0, 1), (45.0, 45.0, 2000)):
        distance = discover.ellipsoidal(c("latitude"), c("longitude"), F.lit(lat), F.lit(lng))
        want = plain.withColumn("d", distance).where("d is not null").orderBy("d", "id").limit(k).collect()
        assert [r["id"] for r in discover.nearest(places, lat, lng, k).collect()] == [r["id"] for r in want], (lat, lng, k)
    assert discover.nearest(places, 0.0, 0.0, 10_000).count() == len(rows) - 2
    assert discover.nearest(places.limit(0), 0.0, 0.0, 3).count() == 0
    near = discover.nearest(places, -30.0, -51.2, 5)
    plan = near._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(latitude," in plan and "LessThanOrEqual(longitude," in plan
    import pyarrow.parquet as pq

    def meets(f):
        g = pq.ParquetFile(f).metadata
        at = {g.row_group(0).column(i).path_in_schema: g.row_group(0).column(i).statistics for i in range(g.num_columns)}
        lat, lng = at["latitude"], at["longitude"]
        return lat.has_min_max and lng.has_min_max and lat.min <= -29.99 and lat.max >= -30.01 and lng.min <= -51.19 and lng.max >= -51.21

    files = [f for f in Path(path).rglob("*.parquet")]
    assert sum(map(meets, files)) <= len(files) // 3
