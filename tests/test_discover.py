import re

import pytest
from pyspark.sql import functions as F

from listwright.operators import discover as D


@pytest.fixture(scope="module")
def store(spark):
    none = F.lit(None).cast("string")
    events = spark.createDataFrame([(f"e{i}", f"Samba {i}", "x", "music", "scheduled", True, i % 4) for i in range(9)], "id string, title string, description string, category_id string, status string, free boolean, venue_id int")
    price = F.struct("free", F.lit(0.0).alias("min"), F.lit(0.0).alias("max"), F.lit("BRL").alias("currency"))
    events = events.withColumns({"price": price, "slug": F.col("id"), "image_url": none, "ticket_url": none, "quality_score": F.lit(0.5), "ranking_score": F.lit(0.5)})
    occ = spark.createDataFrame([(f"o{i}{k}", f"e{i}", "timed", f"2026-05-0{1 + i % 3} 2{k}:00:00") for i in range(9) for k in range(2)], "id string, event_id string, temporal_kind string, at string")
    day = F.lit(None).cast("date")
    occ = occ.select("id", "event_id", "temporal_kind", F.col("at").cast("timestamp").alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"), day.alias("start_date"), day.alias("end_date"), F.lit("scheduled").alias("status"))
    venues = spark.createDataFrame([(i, f"v{i}", -30.0 - i / 1000, -51.2) for i in range(4)], "id int, name string, latitude double, longitude double")
    venues = venues.withColumns({c: none for c in ("address", "neighborhood", "city", "state", "country")})
    refs = spark.createDataFrame([(f"e{i}", s) for i in range(9) for s in ("b", "a")], "event_id string, source_id string").withColumns({"external_id": none, "url": none, "confidence": F.lit(0.5)})
    return events, occ, venues, refs


@pytest.mark.parametrize("place", [{}, {"lat": -30.0, "lng": -51.2, "radius": 250}])
def test_pages_to_the_end_are_the_whole_in_order(spark, store, place):
    hidden = spark.createDataFrame([("e4",)], "id string")
    # venues 0 to 2 lie within 250 m
    far = lambda i: i % 4 if place else 0
    want = [f"e{i}" for i in sorted((i for i in range(9) if i != 4 and (not place or i % 4 < 3)), key=lambda i: (far(i), i % 3, i))]
    got, after = [], None
    while len(got) <= len(want):
        rows, key = D.public_page(*store, D.Request(limit=3, after=after, **place), hidden)
        page = rows.orderBy("pos").collect()
        assert [r["pos"] for r in page] == list(range(1, len(page) + 1))
        assert all(len(r["occurrences"]) == 2 and [s["source_id"] for s in r["sources"]] == ["a", "b"] for r in page)
        assert ("distance_meters" in rows.columns) == bool(place)
        got += [r["id"] for r in page]
        following = key.first()
        if not following["has_more"]:
            break
        after = tuple(following["next_key"])
    assert got == want


def test_a_key_of_the_other_order_is_refused(store):
    with pytest.raises(ValueError, match="key"):
        D.public_page(*store, D.Request(after=(1.0, "2026-05-01 20:00:00", "e1")))
    with pytest.raises(ValueError, match="key"):
        D.public_page(*store, D.Request(lat=-30.0, lng=-51.2, after=("2026-05-01 20:00:00", "e1")))


TERMS = ["samba", "SAMBA na praça", "x", "o", "", "zz", "ñandú", "rock in", "in ro", "%", "日", "sambas", "praca", "a", "roda de", "samb", None]


def wide(spark):
    texts = ["Samba na Praça", "Roda de samba", "Rock in Rio", "Feira do livro", "x", "", "Ñandú 日本", "100% samba-rock", "Noite", "Sambas e choros"]
    rows = [(f"e{i:02}", texts[i % 10], texts[(i * 7 + 3) % 10] + f" {i}", "m", ["scheduled", "cancelled"][i % 3 == 0], True, i % 4 if i % 5 else None) for i in range(60)]
    events = spark.createDataFrame(rows, "id string, title string, description string, category_id string, status string, free boolean, venue_id int")
    day = F.lit(None).cast("date")
    occ = events.select(F.concat("id", F.lit("o")).alias("id"), F.col("id").alias("event_id"), F.lit("timed").alias("temporal_kind"), F.lit("2026-05-01 20:00:00").cast("timestamp").alias("starts_at"), day.alias("start_date"), day.alias("end_date"))
    venues = spark.createDataFrame([(0, "Praça Central", -30.0, -51.0), (1, "Rock Bar", -30.1, -51.0), (2, None, None, None), (3, "o", -30.0, -51.1)], "id int, name string, latitude double, longitude double")
    return events, occ, venues


def plainly_found(events, venues, term, status="scheduled"):
    def grams(t):
        return [w[i : i + 3] for w in (f"  {w} " for w in re.findall(r"[^\W_]+", (t or "").lower())) for i in range(len(w) - 2)]

    def best(a, b):
        q, top = set(grams(a)), 0.0
        for i in range(len(b)):
            for j in range(i + 1, len(b) + 1):
                top = max(top, len(q & set(b[i:j])) / len(q | set(b[i:j])))
        return top

    names = {r["id"]: r["name"] for r in venues.collect()}
    out = set()
    for r in events.where(F.col("status") == status).collect():
        place = names.get(r["venue_id"])
        held = any(term.lower() in (x or "").lower() for x in (r["title"], r["description"], place) if x is not None)
        if held or best(term, grams(r["title"])) > 0.3 or best(term, grams(place)) > 0.3:
            out.add(r["id"])
    return out


def test_text_requests_by_stored_index(spark, tmp_path, monkeypatch):
    """Every request gets what a scan gives, one by one and in a batch; a term's grams are filters of the index's scan."""
    events, occ, venues = wide(spark)
    path = str(tmp_path / "index")
    D.write_text_index(D.text_index(events, venues), path)
    index = spark.read.parquet(path)
    terms = [t for t in TERMS if t]
    want = {t: plainly_found(events, venues, t) for t in terms}
    assert {len(v) for v in want.values()} >= {0} and max(map(len, want.values())) > 20
    for t in ("samba", "x", "in ro", "praca", "%"):
        rows = D.found(events, occ, venues, D.Request(q=t), None, index)
        assert {r["id"] for r in rows.select("id").collect()} == want[t], t
    plan = D.with_text(index, "zz")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan.replace("PushedFilters: [", "") and "PartitionFilters: [part" in plan
    shape = "struct<limit: int, start: date, end: date, status: string, category: string, q: string, free: boolean, lat: double, lng: double, radius: long>"
    requests = spark.createDataFrame([(i, (100, None, None, "scheduled", None, t, None, None, None, None)) for i, t in enumerate(TERMS)], f"request_id int, params {shape}")
    for own, few in ((index, 500), (None, 500), (None, 3)):
        monkeypatch.setattr(D, "FEW_TERMS", few)
        rows = D.discover_batch(events, occ, venues, requests, None, own)
        got = {}
        for r in rows.select("request_id", "id").collect():
            got.setdefault(TERMS[r["request_id"]], set()).add(r["id"])
        for t in terms:
            assert got.get(t, set()) == want[t], t
        assert len(got[None]) == 40
    assert "Python" not in D.discover_batch(events, occ, venues, requests)._jdf.queryExecution().executedPlan().toString()


def test_requests_of_equal_filters_share_their_events(spark):
    """Requests aren't multiplied by events: equal ranges are met once, and each request still gets what it gets alone."""
    from datetime import date, datetime

    events = spark.createDataFrame([(f"e{i:02}", "show de rock" if i % 3 else "samba", None, "ab"[i % 2], "scheduled", [True, False, None][i % 3], i % 5 if i % 7 else None) for i in range(60)], "id string, title string, description string, category_id string, status string, free boolean, venue_id int")
    occ = spark.createDataFrame([(f"e{i:02}", "timed", datetime(2026, 5, 1 + (i * 7 + k) % 9, 20), None, None) for i in range(60) for k in range(1 + i % 2)], "event_id string, temporal_kind string, starts_at timestamp, start_date date, end_date date")
    venues = spark.createDataFrame([(i, f"v{i}", -30 - i / 300 if i else None, -51.2) for i in range(5)], "id int, name string, latitude double, longitude double")
    asked = [(i, ([2, 9, 40][i % 3], *((date(2026, 5, 2), date(2026, 5, 4)) if i % 4 else (None, None)), "scheduled", "a" if i % 5 == 1 else None, "samba" if i % 6 == 2 else None, True if i % 7 == 3 else None, *((-30.002 - i / 9999, -51.2, 400 + i * 20) if i % 2 else (None, None, None)))) for i in range(40)]
    shape = "struct<limit: int, start: date, end: date, status: string, category: string, q: string, free: boolean, lat: double, lng: double, radius: long>"
    requests = spark.createDataFrame(asked, f"request_id int, params {shape}")
    got = {}
    for r in D.discover_batch(events, occ, venues, requests).orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append(r["id"])
    for i, (limit, start, end, status, category, q, free, lat, lng, radius) in asked[:8]:
        own = D.discover(events, occ, venues, D.Request(start, end, status, category, free, q, lat, lng, radius or 1, limit))
        assert got.get(i, []) == [r["id"] for r in own.select("id").collect()], i
    flat = requests.select("request_id", "params.*").withColumnRenamed("start", "from").withColumnRenamed("end", "to")
    dated = occ.select(F.col("event_id").alias("id"), F.lit("scheduled").alias("status"), F.col("starts_at").alias("instant"), F.to_date("starts_at").alias("first"), F.to_date("starts_at").alias("last"))
    assert D.by_dates(flat, dated).count() <= 60
