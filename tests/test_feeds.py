import hashlib
import json

from pyspark.sql import functions as F

from listwright.operators import evaluate as E
from listwright.operators import normalize as N
from listwright.sources import feeds
from listwright.streaming import stream

NOW = "2026-01-01 00:00:00"


def write(path, document):
    path.write_text(json.dumps(document))
    return str(path)


def agenda(**k):
    return {"id": "a1", "title": "Sarau", "startDate": "2026-03-01"} | k


def normalized(spark, tmp_path, *rows):
    df = feeds.agenda_feed(spark, write(tmp_path / "a.json", {"events": list(rows)}))
    return N.normalize_agenda(df, F.lit(NOW)).collect()


def test_agenda_occurrences(spark, tmp_path):
    rows = normalized(
        spark, tmp_path, agenda(startTime="19:30", endTime="21:00"), agenda(id="a2", startTime="25:00"), agenda(id="a3", startTime="19:30", endDate="2026-03-05"), agenda(id="a4", startTime="19:30", endTime="18:00"), agenda(id=" ", url=None), agenda(id="a6", startDate=None)
    )
    kinds = [(r["occurrence"]["temporal_kind"], str(r["occurrence"]["starts_at"]), str(r["occurrence"]["ends_at"])) for r in rows[:4]]
    assert kinds == [("timed", "2026-03-01 22:30:00", "2026-03-02 00:00:00"), ("date", "None", "None"), ("date", "None", "None"), ("timed", "2026-03-01 22:30:00", "None")]
    assert [r["reason"] for r in rows] == [None, None, None, None, "missing id", "missing date"]


def test_ticket_feed(spark, tmp_path):
    event = {"id": "1", "name": "Show", "dates": {"start": {"dateTime": "2026-03-01T23:00:00Z"}, "status": {"code": "onsale"}}, "priceRanges": [{"currency": "BRL", "min": 0, "max": 0}]}
    other = {**event, "id": "2", "dates": {"start": {"localDate": "2026-03-01"}, "status": {"code": "onsale"}}}
    path = write(tmp_path / "t.json", {"_embedded": {"events": [event, other, {**event, "id": "3", "dates": {"status": {"code": "x"}}}]}})
    rows = N.normalize_ticket(feeds.ticket_feed(spark, path), F.lit(NOW)).collect()
    assert [r["reason"] for r in rows] == [None, "no precise start", "unmappable status: x"]
    assert rows[0]["price"]["free"] is True and rows[0]["price"]["min"] is None and rows[0]["venue"] is None


def test_empty_ticket_feed(spark, tmp_path):
    assert feeds.ticket_feed(spark, write(tmp_path / "e.json", {"page": 1})).count() == 0


def test_curated_reasons(spark, tmp_path):
    good = {"id": "m1", "title": "Feira", "startDate": "2026-04-01", "venueName": "Parque", "sourceUrl": "https://x.example"}
    rows = [good, {**good, "venueName": " "}, {**good, "latitude": -30.0}, {**good, "latitude": -95.0, "longitude": 1.0}, {**good, "priceValue": -1.0}, {**good, "imageUrl": "https://x.example/i.png"}]
    done = N.normalize_curated(feeds.curated_feed(spark, write(tmp_path / "m.json", {"events": rows})), F.lit(NOW)).collect()
    assert [r["reason"] for r in done] == [None, "missing venue", "one coordinate without the other", "coordinates out of range", "invalid priceValue", None]
    assert done[5]["image_url"] is None
    ok, bad = N.split(N.normalize_curated(feeds.curated_feed(spark, str(tmp_path / "m.json")), F.lit(NOW)))
    assert (ok.count(), bad.count()) == (2, 4)


def test_content_hash_ignores_key_order(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": {"c": 2.50, "d": null}}',), ('{"b": {"d": null, "c": 2.5}, "a": 1}',)], "p string")
    assert rows.select(feeds.content_hash(F.col("p"))).distinct().count() == 1


def test_page_structure(spark):
    pages = [(1, '<script type="application/ld+json">{"@type": "Event"}</script>'), (2, '<a href="https://destinopoa.com.br/evento/x/">'), (3, '<script type="application/ld+json">{"@type": "WebSite"}</script>'), (4, None)]
    rows = feeds.page_structure(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id").collect()
    assert [r["strategy"] for r in rows] == ["json-ld", "html", "unknown", "unknown"]


def test_streamed_feed_and_analytics(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "1.json", {"events": [agenda(), agenda(id=None)]})
    out = [str(tmp_path / x) for x in ("good", "bad", "check")]
    rows = stream.feed_stream(spark, str(folder), f"events array<struct<{feeds.AGENDA_FIELDS}>>")
    for _ in range(2):
        stream.ingest(rows, lambda df: N.normalize_agenda(df, F.lit(NOW)), *out).awaitTermination()
    assert (spark.read.parquet(out[0]).count(), spark.read.parquet(out[1]).count()) == (1, 1)

    events = tmp_path / "analytics"
    events.mkdir()
    row = {"event_name": "page_view", "created_at": "2026-01-01T00:00:00Z"}
    (events / "1.json").write_text("\n".join(map(json.dumps, [row, row, {**row, "event_name": "nope"}])))
    stream.append_analytics(stream.analytics_stream(spark, str(events)), str(tmp_path / "a"), str(tmp_path / "ac")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "a"))
    assert kept.count() == 2 and kept.select("id").distinct().count() == 2  # two equal views of one instant are two


def test_demo_feed_roots_images(spark, tmp_path):
    rows = [{"id": "d1", "imageUrl": "/img/a.png"}, {"id": "d2", "imageUrl": "https://x.example/b.png"}, {"id": "d3"}]
    got = feeds.demo_feed(spark, write(tmp_path / "d.json", {"events": rows}), "https://base.example/").orderBy("id").collect()
    assert [r["imageUrl"] for r in got] == ["https://base.example/img/a.png", "https://x.example/b.png", None]


def test_known_digest(spark):
    digest = hashlib.sha256(b'{"a":1,"b":{"c":2.5,"d":null},"e":[3,"x"]}').hexdigest()
    given = spark.createDataFrame([('{"e": [3, "x"], "b": {"d": null, "c": 2.50}, "a": 1}',)], "p string")
    assert given.select(feeds.content_hash(F.col("p")).alias("h")).first()["h"] == digest


def test_registry_and_since(spark):
    registry = feeds.source_registry(spark)
    assert registry.count() == 4 and registry.select("id").distinct().count() == 4
    (own,) = feeds.registered(registry, feeds.AGENDA).collect()
    assert (own["type"], own["polling_interval_minutes"], own["authority_score"], own["commercial_use"]) == ("crawler", 240, 0.75, "unknown")
    assert feeds.registered(registry, "none").count() == 0
    assert N.violations(registry, "id", N.source_rules()).count() == 0
    rows = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("b", "2026-01-02 00:00:00"), ("c", None)], "id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    assert [r["id"] for r in feeds.since(rows, "at", F.lit("2026-01-02 00:00:00").cast("timestamp")).collect()] == ["b"]
    assert feeds.since(rows, "at", None).count() == 3


def labelled(i, **k):
    side = lambda n, kind: {"id": f"e{i}{n}", "title": "Mostra", "occurrence": {"kind": kind, "startDate": "2026-02-01"}, "venue": {"name": "Sala"}, "source": {"sourceId": "s"}}
    return {"id": f"C{i:02}", "left": side("l", "date"), "right": side("r", "timed"), "identityTruth": "same", "expectedRouting": "review", "criticalConflicts": [], "rationale": "why", "tags": ["t"], "difficulty": "easy"} | k


def test_labelled_pairs_and_their_rules(spark, tmp_path):
    cases = [labelled(i, identityTruth=E.TRUTHS[i % 3], expectedRouting=E.ROUTINGS[i % 3]) for i in range(40)]
    rows = feeds.labelled_pairs(spark, write(tmp_path / "g.json", {"version": 1, "cases": cases}))
    r = rows.orderBy("id").first()
    assert (r["left"]["venue"]["city"], r["left"]["venue"]["state"], r["right"]["source"]["confidence"], r["right"]["status"]) == ("Porto Alegre", "RS", 0.8, "scheduled")
    assert str(r["left"]["seenAt"]) == "2026-01-01 00:00:00"
    assert [tuple(r) for r in E.dataset_errors(rows).collect()] == [("kind_not_covered", "date-range")]
    long = labelled(40)
    long["left"]["occurrence"]["endDate"] = "2026-02-03"
    assert E.dataset_errors(feeds.labelled_pairs(spark, write(tmp_path / "l.json", {"cases": [*cases, long]}))).count() == 0
    bad = [labelled(0, identityTruth="maybe"), labelled(0, criticalConflicts=["odd"], tags=[], rationale=" "), labelled(2, difficulty="hard", tags=["x", "t"], criticalConflicts=["date_conflict"])]
    rows = feeds.labelled_pairs(spark, write(tmp_path / "b.json", {"cases": bad}))
    got = sorted((r["code"], r["key"]) for r in E.dataset_errors(rows).collect())
    assert got == sorted([("unknown_truth", "C00"), ("unknown_conflict", "C00"), ("empty_tags", "C00"), ("empty_rationale", "C00"), ("repeated_case", "C00"), ("repeated_event", "e0l"), ("repeated_event", "e0r"), ("too_few_cases", "3"), ("kind_not_covered", "date-range"), ("truth_not_covered", "different"), ("truth_not_covered", "uncertain"), ("routing_not_covered", "auto_merge"), ("routing_not_covered", "separate")])
    tags = {(r["dimension"], r["value"]): r["n"] for r in E.dataset_summary(rows).collect() if r["dimension"] in ("tags", "criticalConflicts", "difficulty")}
    assert tags == {("tags", "t"): 2, ("tags", "x"): 1, ("criticalConflicts", "odd"): 1, ("criticalConflicts", "date_conflict"): 1, ("difficulty", "easy"): 2, ("difficulty", "hard"): 1}


def test_fixed_holdout(spark):
    cases = spark.createDataFrame([(x,) for x in [*E.HOLDOUT, "GD-P01", "GD-A10"]], "case_id string")
    assert {r["case_id"] for r in E.partition(cases, "holdout").collect()} == set(E.HOLDOUT)
    assert {r["case_id"] for r in E.partition(cases, "calibration").collect()} == {"GD-P01", "GD-A10"}
    assert E.partition(cases, "all").count() == 12


def test_performers_and_images_of_tickets(spark, tmp_path):
    event = {"id": "1", "name": "Show", "dates": {"start": {"dateTime": "2026-03-01T23:00:00Z"}, "status": {"code": "onsale"}}, "images": [{"url": "https://x.example/1.png"}, {"url": "https://x.example/2.png"}]}
    acts = [{"id": "p9", "name": "Duo Sul"}, {"name": "Água Viva"}, {"id": "p3", "name": ""}, {"id": "", "name": "X"}]
    path = write(tmp_path / "t.json", {"_embedded": {"events": [{**event, "_embedded": {"attractions": acts}}, {**event, "id": "2"}]}})
    one, other = N.normalize_ticket(feeds.ticket_feed(spark, path), F.lit(NOW)).orderBy("external_id").collect()
    assert [tuple(p) for p in one["performers"]] == [("p9", "Duo Sul"), ("performer-agua-viva", "Água Viva"), ("performer-x", "X")]
    assert one["image_url"] == "https://x.example/1.png" and other["performers"] == []


def test_curated_images_need_confirmed_rights(spark, tmp_path):
    good = {"id": "m1", "title": "Feira", "startDate": "2026-04-01", "venueName": "Parque", "sourceUrl": "https://x.example", "imageUrl": "https://x.example/i.png"}
    rows = [{**good, "imageRightsConfirmed": x, "id": f"m{i}"} for i, x in enumerate((True, False, None))]
    done = N.normalize_curated(feeds.curated_feed(spark, write(tmp_path / "m.json", {"events": rows})), F.lit(NOW)).orderBy("external_id").collect()
    assert [r["image_url"] for r in done] == ["https://x.example/i.png", None, None]


def test_rules_of_rows(spark):
    at = "timestamp'2026-01-0{} 00:00:00'"
    events = spark.sql(f"""SELECT * FROM VALUES ('good', 'T', 's', array(1), array(1), 0.5D, {at.format(1)}, {at.format(2)}, {at.format(1)}, {at.format(1)}),
      ('bad', ' ', '', array(), NULL, 1.5D, {at.format(2)}, {at.format(1)}, {at.format(3)}, {at.format(2)}) AS t(id, title, slug, occurrences, sources, quality_score, first_seen_at, last_seen_at, created_at, updated_at)""")
    got = {r["id"]: r["violations"] for r in N.violations(events, "id", N.event_rules()).collect()}
    assert got == {"bad": ["blank_title", "blank_slug", "no_occurrence", "no_source", "quality_out_of_range", "seen_order", "update_order"]}
    places = spark.createDataFrame([("a", 90.0, -180.0), ("b", 90.1, 0.0), ("c", 0.0, 181.0), ("d", None, None)], "id string, latitude double, longitude double")
    assert {r["id"]: r["violations"] for r in N.violations(places, "id", N.venue_rules()).collect()} == {"b": ["latitude_out_of_range"], "c": ["longitude_out_of_range"]}
    refs = spark.createDataFrame([("a", 1.0), ("b", -0.1)], "id string, confidence double")
    assert {r["id"] for r in N.violations(refs, "id", N.reference_rules()).collect()} == {"b"}
    sources = spark.createDataFrame([("a", 0.0, 1), ("b", 1.1, 0)], "id string, authority_score double, polling_interval_minutes int")
    assert {r["id"]: r["violations"] for r in N.violations(sources, "id", N.source_rules()).collect()} == {"b": ["authority_out_of_range", "polling_not_positive"]}
