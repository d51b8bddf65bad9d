"""Registered queries of blocking, signals, the engine, candidates, suppression and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.operators import dedup as M
from listwright.operators import evaluate as E

from .catalog import OCC, query, sql_haversine, sql_local_date, sql_normal, sql_similarity, sql_token_similarity, sql_tokens, sql_trigrams, sql_word_similarity
from .views import TITLE, view

OVERLAP = f"""{OCC}, o AS (SELECT occ.*, e.title FROM occ JOIN v_events e ON e.id = occ.event_id WHERE e.status = 'scheduled'),
  src AS (SELECT event_id, list(source_id) AS s FROM v_refs GROUP BY event_id),
  near AS (SELECT DISTINCT a.event_id AS left_id, b.event_id AS right_id FROM o a JOIN o b ON a.event_id < b.event_id AND a.first_day <= b.last_day AND b.first_day <= a.last_day)"""


SHORT = "(category_id || ' ' || source_id)"
BLOCK = f"""{OVERLAP}, g AS (SELECT id, {sql_trigrams(SHORT)} AS t FROM v_events),
  far AS (SELECT left_id, right_id, l.t AS lt, r.t AS rt FROM near JOIN src a ON a.event_id = left_id JOIN src b ON b.event_id = right_id JOIN g l ON l.id = left_id JOIN g r ON r.id = right_id WHERE NOT list_has_any(a.s, b.s)),
  sim AS (SELECT left_id, right_id, lt, rt, {sql_similarity('lt', 'rt')} AS s FROM far)"""


def store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    return tuple(view(spark, sf_dir, n) for n in ("v_events", "v_occurrences", "v_venues", "v_refs"))


@query(f"WITH {OVERLAP} SELECT left_id, right_id FROM near JOIN src a ON a.event_id = left_id JOIN src b ON b.event_id = right_id WHERE NOT list_has_any(a.s, b.s)")
def block_overlap(spark, sf_dir):
    events, occurrences, _, refs = store(spark, sf_dir)
    own = M.spans(occurrences).join(events.where("status = 'scheduled'").select(F.col("id").alias("event_id")), "event_id", "left_semi")
    src = refs.groupBy("event_id").agg(F.collect_set("source_id").alias("sources"))
    return M.overlapping(own, src)


@query(f"WITH {BLOCK.replace(sql_trigrams(SHORT), sql_trigrams('title'))} SELECT left_id, right_id FROM sim WHERE CASE WHEN s > 0.15 THEN true WHEN len(list_intersect(lt, rt)) <= 0.15 * len(list_distinct(lt)) THEN false ELSE {sql_word_similarity('lt', 'rt')} > 0.15 END")
def block_pairs(spark, sf_dir):
    events, occurrences, _, refs = store(spark, sf_dir)
    return M.candidate_pairs(events, occurrences, refs)


@query(f"WITH {BLOCK} SELECT left_id, right_id FROM sim WHERE s > 0.15 OR {sql_word_similarity('lt', 'rt')} > 0.15")
def block_pairs_short_titles(spark, sf_dir):
    """All events once more, each with a short field as its title: its language and source."""
    events, occurrences, _, refs = store(spark, sf_dir)
    return M.candidate_pairs(events.withColumn("title", F.concat("category_id", F.lit(" "), "source_id")), occurrences, refs)


# signals: an event beside the next one of its language, with the venues, dates, names and links that documents give

SIDES = f"""SELECT doc_id, CAST(doc_id AS STRING) AS id, {TITLE} AS title, lang, source,
  CASE doc_id % 3 WHEN 0 THEN source || ' é ' || lang WHEN 1 THEN upper(lang) ELSE source END AS first_name, CASE doc_id % 2 WHEN 0 THEN lang ELSE source END AS second_name, CASE WHEN doc_id % 3 = 0 THEN 'date' ELSE 'timed' END AS kind,
  CASE WHEN doc_id % 3 <> 0 THEN make_timestamp(2024, 1, CAST(1 + doc_id % 3 AS INT), CAST(doc_id % 24 AS INT), CAST(doc_id % 60 AS INT), 0) END AS starts_at, CASE WHEN doc_id % 3 = 0 THEN make_date(2024, 1, CAST(1 + doc_id % 4 AS INT)) END AS start_date,
  CASE WHEN doc_id % 6 = 0 THEN make_date(2024, 1, CAST(1 + doc_id % 4 + doc_id % 5 AS INT)) END AS end_date, CASE WHEN doc_id % 10 <> 0 THEN coalesce(p_name, lang) || ' da ' || source END AS venue, CASE WHEN doc_id % 2 = 0 THEN source END AS address,
  CASE WHEN doc_id % 5 <> 0 THEN lang END AS neighborhood, CASE WHEN doc_id % 50 = 7 THEN 'other' ELSE 'poa' END AS city, CASE WHEN doc_id % 4 <> 0 THEN -30e0 - (doc_id % 40) / 1000e0 END AS lat, CASE WHEN doc_id % 4 <> 0 THEN -51e0 - (doc_id % 9) / 1000e0 END AS lng,
  CASE WHEN doc_id % 3 = 1 THEN 'https://T.example/' || source || '/' ELSE 'https://t.example/' || source END AS ticket, CASE WHEN doc_id % 4 = 1 THEN 'u' || lang END AS page FROM documents LEFT JOIN part ON p_partkey = doc_id % 200"""
BOTH = f"s AS ({SIDES}), p AS (SELECT a.doc_id, a AS l, b AS r FROM s a JOIN s b ON b.doc_id = a.doc_id + 20)"
LOCAL_L, LOCAL_R = sql_local_date("l.starts_at"), sql_local_date("r.starts_at")


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(SIDES.replace("FROM documents", "FROM {d}").replace("JOIN part", "JOIN {p}"), d=view(spark, sf_dir, "documents"), p=view(spark, sf_dir, "part"))
    c = F.col
    venue = F.when(c("venue").isNotNull(), F.struct(c("venue").alias("name"), c("address"), c("neighborhood"), c("city"), c("lat").alias("latitude"), c("lng").alias("longitude")))
    people = F.transform(F.array("first_name", "second_name"), lambda w: F.struct(w.alias("name")))
    side = F.struct(c("title"), F.struct(c("kind").alias("temporal_kind"), "starts_at", "start_date", "end_date").alias("occurrence"), venue.alias("venue"), people.alias("performers"), c("ticket").alias("ticket_url"), c("page").alias("canonical_url"))
    left = s.select("doc_id", side.alias("left"))
    return left.join(s.select((c("doc_id") - 20).alias("doc_id"), side.alias("right")), "doc_id")


TIME_SQL = f"""t AS (SELECT *, l.kind = 'timed' AND r.kind = 'timed' AS timed, {LOCAL_L} = {LOCAL_R} AS same_day, abs(epoch_us(l.starts_at) - epoch_us(r.starts_at)) / 60e6 AS minutes,
    CASE WHEN l.kind = 'timed' THEN {LOCAL_L} ELSE l.start_date END AS a1, CASE WHEN l.kind = 'timed' THEN {LOCAL_L} ELSE coalesce(l.end_date, l.start_date) END AS a2,
    CASE WHEN r.kind = 'timed' THEN {LOCAL_R} ELSE r.start_date END AS b1, CASE WHEN r.kind = 'timed' THEN {LOCAL_R} ELSE coalesce(r.end_date, r.start_date) END AS b2 FROM p),
  u AS (SELECT *, date_diff('day', greatest(a1, b1), least(a2, b2)) + 1 AS shared, date_diff('day', a1, a2) + 1 + date_diff('day', b1, b2) + 1 AS total FROM t),
  temporal AS (SELECT *, CASE WHEN timed THEN CASE WHEN NOT same_day THEN 0e0 ELSE greatest(0e0, 1 - minutes / 240) END WHEN shared <= 0 THEN 0e0 ELSE 2e0 * shared / total END AS tsim,
    CASE WHEN timed THEN CASE WHEN NOT same_day THEN 'date_conflict' WHEN minutes > 180 THEN 'time_conflict' END WHEN shared <= 0 THEN 'date_conflict' END AS tconflict,
    CASE WHEN timed THEN 'timed_pair' WHEN l.kind = 'timed' OR r.kind = 'timed' THEN 'mixed_precision' ELSE 'date_pair' END AS evidence FROM u)"""


@query(f"WITH {BOTH}, {TIME_SQL} SELECT doc_id, round(tsim, 9) AS similarity, tconflict AS conflict, evidence FROM temporal")
def signal_temporal(spark, sf_dir):
    rows = sided(spark, sf_dir).select("doc_id", M.temporal_signal(F.col("left.occurrence"), F.col("right.occurrence")).alias("t"))
    return rows.select("doc_id", F.round("t.similarity", 9).alias("similarity"), "t.conflict", "t.evidence")


# least() and greatest() pass over nulls
METRES = f"CASE WHEN l.lat IS NOT NULL AND r.lat IS NOT NULL THEN {sql_haversine('l.lat', 'l.lng', 'r.lat', 'r.lng')} END"
VENUES = "l.venue IS NOT NULL AND r.venue IS NOT NULL"


@query(f"WITH {BOTH} SELECT doc_id, CASE WHEN {VENUES} AND l.lat IS NOT NULL AND r.lat IS NOT NULL THEN round(greatest(0e0, 1 - {METRES} / 1000), 9) END AS similarity FROM p")
def signal_geo(spark, sf_dir):
    return sided(spark, sf_dir).select("doc_id", F.round(M.geo_signal(F.col("left.venue"), F.col("right.venue")), 9).alias("similarity"))


TOKENS_SQL = ", ".join(f"{sql_tokens(f'{s}.{c}')} AS {s}_{c}" for s in "lr" for c in ("title", "venue", "address", "neighborhood"))
VENUE_SQL = f"""k AS (SELECT *, {TOKENS_SQL} FROM {{0}}),
  w AS (SELECT *, CASE WHEN {VENUES} THEN {sql_token_similarity('l_venue', 'r_venue')} END AS name_sim, CASE WHEN l.address IS NOT NULL AND r.address IS NOT NULL THEN {sql_token_similarity('l_address', 'r_address')} END AS a_sim,
    CASE WHEN l.neighborhood IS NOT NULL AND r.neighborhood IS NOT NULL THEN {sql_token_similarity('l_neighborhood', 'r_neighborhood')} END AS n_sim FROM k),
  venue AS (SELECT *, CASE WHEN name_sim IS NULL THEN NULL WHEN a_sim IS NULL AND n_sim IS NULL THEN name_sim ELSE 0.8e0 * name_sim + 0.2e0 * CASE WHEN a_sim IS NULL THEN n_sim WHEN n_sim IS NULL THEN a_sim ELSE (a_sim + n_sim) / 2 END END AS vsim FROM w)"""


@query(f"WITH {BOTH}, {VENUE_SQL.replace('{0}', 'p')} SELECT doc_id, round(vsim, 9) AS similarity FROM venue")
def signal_venue(spark, sf_dir):
    return sided(spark, sf_dir).select("doc_id", F.round(M.venue_signal(F.col("left.venue"), F.col("right.venue")), 9).alias("similarity"))


# each side names two performers, in any order, some of them in others' names: the first takes the first that fits, the
# second the first that is left
def sql_fits(a: str, b: str) -> str:
    x, y = sql_normal(f"l.{a}_name"), sql_normal(f"r.{b}_name")
    return f"(contains({x}, {y}) OR contains({y}, {x}))"


TAKEN = f"CASE WHEN {sql_fits('first', 'first')} THEN 1 WHEN {sql_fits('first', 'second')} THEN 2 ELSE 0 END"
PEOPLE_SQL = f"""2e0 * (CASE WHEN {TAKEN} > 0 THEN 1 ELSE 0 END + CASE WHEN {TAKEN} <> 1 AND {sql_fits('second', 'first')} THEN 1 WHEN {TAKEN} <> 2 AND {sql_fits('second', 'second')} THEN 1 ELSE 0 END) / 4"""


@query(f"WITH {BOTH} SELECT doc_id, round({PEOPLE_SQL}, 9) AS similarity FROM p")
def signal_performer(spark, sf_dir):
    return sided(spark, sf_dir).select("doc_id", F.round(M.performer_signal(F.col("left.performers"), F.col("right.performers")), 9).alias("similarity"))


URL_SQL = "CASE WHEN regexp_replace(lower(trim(l.ticket)), '/+$', '') = regexp_replace(lower(trim(r.ticket)), '/+$', '') THEN 1e0 ELSE 0e0 END"


@query(f"WITH {BOTH} SELECT doc_id, {URL_SQL} AS similarity FROM p")
def signal_url(spark, sf_dir):
    return sided(spark, sf_dir).select("doc_id", M.url_signal(F.col("left"), F.col("right")).alias("similarity"))


YEAR = r"nullif(regexp_extract({0}.title, '\b(19|20)\d{{2}}\b', 0), '')"
ASSESS_SQL = f"""{TIME_SQL}, {VENUE_SQL.replace('{0}', 'temporal')},
  sig AS (SELECT *, {sql_token_similarity('l_title', 'r_title')} AS title_sim, CASE WHEN {VENUES} THEN {METRES} END AS metres, {URL_SQL} AS url_sim, {PEOPLE_SQL} AS psim, {YEAR.format('l')} AS l_year, {YEAR.format('r')} AS r_year FROM venue),
  sc AS (SELECT *, least(1e0, greatest(0e0, (0.4e0 * title_sim + coalesce(0.2e0 * vsim, 0) + 0.2e0 * tsim + CASE WHEN metres IS NULL THEN 0 ELSE 0.1e0 * greatest(0e0, 1 - metres / 1000) END + 0.1e0 * psim) / (0.4e0 + CASE WHEN vsim IS NULL THEN 0 ELSE 0.2e0 END + 0.2e0 + CASE WHEN metres IS NULL THEN 0 ELSE 0.1e0 END + 0.1e0)
    + CASE WHEN url_sim = 1 THEN 0.05e0 ELSE 0 END)) AS score,
    list_filter([tconflict, CASE WHEN {VENUES} AND l.city IS DISTINCT FROM r.city THEN 'city_conflict' END, CASE WHEN {VENUES} AND CASE WHEN metres IS NOT NULL THEN metres > 1500 ELSE name_sim < 0.2 END THEN 'venue_conflict' END, CASE WHEN l_year <> r_year THEN 'edition_conflict' END], lambda x: x IS NOT NULL) AS conflicts FROM sig),
  done AS (SELECT doc_id, round(score, 9) AS score, array_to_string(conflicts, ',') AS conflicts, CASE WHEN list_has_any(conflicts, ['date_conflict', 'time_conflict', 'city_conflict', 'edition_conflict']) THEN 'separate' WHEN len(conflicts) > 0 THEN 'review'
    WHEN evidence <> 'mixed_precision' AND score >= 0.99 THEN 'auto_merge' WHEN score >= 0.8 THEN 'review' ELSE 'separate' END AS routing FROM sc)"""


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.assess(sided(spark, sf_dir))


@query(f"WITH {BOTH}, {ASSESS_SQL} SELECT * FROM done")
def assess_pairs(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", F.round("score", 9).alias("score"), F.array_join("conflicts", ",").alias("conflicts"), "routing")


@query(f"WITH {BOTH}, {ASSESS_SQL} SELECT routing, count(*) AS n FROM done GROUP BY 1")
def route_counts(spark, sf_dir):
    return assessed(spark, sf_dir).groupBy("routing").agg(F.count("*").alias("n"))


def sql_two(c: str) -> str:
    """Two decimals of the number as it is written, half away from zero."""
    return f"CAST(CAST(round(CAST(CAST({c} AS VARCHAR) AS DECIMAL(30, 20)), 2) AS DECIMAL(10, 2)) AS VARCHAR)"


REASONS_SQL = f"""array_to_string(list_filter(['title similarity: ' || {sql_two('title_sim')},
    CASE WHEN vsim IS NULL THEN 'venue: unknown (missing on one or both sides)' ELSE 'venue similarity: ' || {sql_two('vsim')} END, 'temporal similarity: ' || {sql_two('tsim')},
    CASE WHEN metres IS NOT NULL THEN 'geo similarity: ' || {sql_two('greatest(0e0, 1 - metres / 1000)')} END, 'performer overlap: ' || {sql_two('psim')},
    CASE WHEN url_sim = 1 THEN 'ticket/canonical URL matches exactly' ELSE 'URLs present but do not match' END,
    CASE WHEN len(s.conflicts) > 0 THEN 'critical conflicts detected: ' || array_to_string(s.conflicts, ', ') ELSE 'no critical conflicts detected' END,
    CASE WHEN evidence = 'mixed_precision' THEN 'auto-merge blocked: {M.MIXED_BLOCKER}' END, 'routing: ' || routing], lambda x: x IS NOT NULL), '; ')"""


@query(f"WITH {BOTH}, {ASSESS_SQL} SELECT s.doc_id, {REASONS_SQL} AS reasons FROM sc s JOIN done d ON d.doc_id = s.doc_id")
def assess_reasons(spark, sf_dir):
    return M.assess(sided(spark, sf_dir)).select("doc_id", F.array_join("reasons", "; ").alias("reasons"))


STATUS = "CASE routing WHEN 'auto_merge' THEN 'auto_approved' WHEN 'review' THEN 'pending_review' ELSE 'separate' END"


def snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old candidates with some human decisions, new assessments)."""
    new = assessed(spark, sf_dir).select("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("left_id"), F.lpad((F.col("doc_id") + 20).cast("string"), 9, "0").alias("right_id"), "score", "signals", "conflicts", "blockers", "routing")
    human = F.col("doc_id") % 6 == 0
    at = F.lit("2024-01-01").cast("timestamp")
    old = new.where("doc_id % 2 = 0").select(
        F.concat(F.lit("c"), F.col("left_id")).alias("id"), "left_id", "right_id", F.lit(0.1).alias("score"), "signals", "conflicts", "blockers", F.when(human, "confirmed_same").otherwise("pending_review").alias("status"),
        F.when(human, "human").otherwise("engine").alias("decision_source"), at.alias("evaluated_at"), F.when(human, at).alias("decided_at"),
    )
    return old, new.where("doc_id % 3 = 0 or doc_id % 5 = 0")


@query(f"""WITH {BOTH}, {ASSESS_SQL} SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS left_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN round(score, 6) ELSE 0.1 END AS score,
    CASE WHEN doc_id % 6 = 0 THEN 'confirmed_same' WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN {STATUS} ELSE 'pending_review' END AS status, CASE WHEN doc_id % 6 = 0 THEN 'human' ELSE 'engine' END AS decision_source,
    CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'updated' ELSE 'created' END END AS change FROM done WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0""")
def candidate_upsert_precedence(spark, sf_dir):
    old, new = snapshot(spark, sf_dir)
    return M.upsert_candidates(old, new, F.lit("2024-02-01")).select("left_id", F.round("score", 6).alias("score"), "status", "decision_source", "change")


@query(f"""WITH {BOTH}, {ASSESS_SQL}, x AS (SELECT doc_id, {STATUS} AS status FROM done WHERE doc_id % 3 = 0 OR doc_id % 5 = 0)
  SELECT count(*) AS pairs, count(*) FILTER (doc_id % 2 <> 0) AS created, count(*) FILTER (doc_id % 2 = 0) AS updated, count(*) FILTER (CASE WHEN doc_id % 6 = 0 THEN false ELSE status = 'auto_approved' END) AS auto_merge,
    count(*) FILTER (CASE WHEN doc_id % 6 = 0 THEN false ELSE status = 'pending_review' END) AS review, count(*) FILTER (CASE WHEN doc_id % 6 = 0 THEN false ELSE status = 'separate' END) AS separate FROM x""")
def dedup_scan_summary(spark, sf_dir):
    old, new = snapshot(spark, sf_dir)
    return M.scan_summary(M.upsert_candidates(old, new, F.lit("2024-02-01")))


@query("""SELECT 'c' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, CASE WHEN doc_id % 4 = 0 THEN 'confirmed_different' WHEN doc_id % 6 = 0 THEN 'confirmed_same' ELSE 'pending_review' END AS status,
  CASE WHEN doc_id % 4 = 0 OR doc_id % 6 = 0 THEN 'human' ELSE 'engine' END AS decision_source FROM documents d WHERE doc_id % 2 = 0 AND doc_id + 20 IN (SELECT doc_id FROM documents)""")
def human_decisions(spark, sf_dir):
    old, _ = snapshot(spark, sf_dir)
    choice = old.where("try_cast(left_id as int) % 4 = 0").select("id", F.lit("confirmed_different").alias("decision"))
    return M.decide(old, choice, F.lit("2024-03-01")).select("id", "status", "decision_source")


@query("""SELECT lpad(CAST(d.doc_id AS VARCHAR), 9, '0') AS left_id, a.title AS left_title, b.title AS right_title FROM documents d JOIN v_events a ON a.doc_id = d.doc_id JOIN v_events b ON b.doc_id = d.doc_id + 20 WHERE d.doc_id % 2 = 0 AND d.doc_id % 6 <> 0""")
def pending_review(spark, sf_dir):
    old, _ = snapshot(spark, sf_dir)
    events = view(spark, sf_dir, "v_events").select(F.lpad("id", 9, "0").alias("id"), "title")
    return M.pending_review(old, events).select("left_id", F.col("left.title").alias("left_title"), F.col("right.title").alias("right_title"))


RANKS = """rk AS (SELECT e.id, e.doc_id, 1 + 1 + CASE WHEN v.id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN latitude IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN free IS NOT NULL THEN 1 ELSE 0 END AS c, r.confidence AS f
  FROM v_events e LEFT JOIN v_venues v ON v.id = e.venue_id JOIN (SELECT event_id, max(confidence) AS confidence FROM v_refs GROUP BY 1) r ON r.event_id = e.id),
  rp AS (SELECT a.id AS left_id, b.id AS right_id, CASE WHEN (a.c, a.f) > (b.c, b.f) OR ((a.c, a.f) = (b.c, b.f) AND a.id < b.id) THEN a.id ELSE b.id END AS representative_id, a.doc_id FROM rk a JOIN rk b ON b.doc_id = a.doc_id + 1)"""


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _, venues, refs = store(spark, sf_dir)
    trust = refs.groupBy(F.col("event_id").alias("id")).agg(F.max("confidence").alias("confidence"))
    place = venues.select(F.col("id").alias("venue_id"), F.lit(True).alias("known"), "latitude", "longitude")
    c = F.col
    points = M.completeness({"description": c("description"), "category_id": c("category_id"), "venue": c("known"), "coordinates": c("latitude").isNotNull() & c("longitude").isNotNull(), "price": c("free").isNotNull()})
    return events.join(place, "venue_id", "left").select("id", "doc_id", points.alias("completeness")).join(trust, "id")


def next_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "v_events").select("doc_id", "id")
    return e.select("doc_id", F.col("id").alias("left_id")).join(e.select((F.col("doc_id") - 1).alias("doc_id"), F.col("id").alias("right_id")), "doc_id")


@query(f"WITH {RANKS} SELECT left_id, right_id, representative_id FROM rp")
def representative_choice(spark, sf_dir):
    return M.representative(next_pairs(spark, sf_dir), ranks(spark, sf_dir)).select("left_id", "right_id", "representative_id")


@query(f"WITH {RANKS} SELECT DISTINCT CASE WHEN representative_id = left_id THEN right_id ELSE left_id END AS id FROM rp WHERE doc_id % 5 IN (0, 1)")
def suppressed_ids(spark, sf_dir):
    d = F.col("doc_id") % 5
    status = F.when(d == 0, "auto_approved").when(d == 1, "confirmed_same").when(d == 2, "confirmed_different").otherwise("pending_review")
    return M.suppressed(next_pairs(spark, sf_dir).withColumn("status", status), ranks(spark, sf_dir))


# evaluation


@query("SELECT expected_routing, count(*) FILTER (routing = 'auto_merge') AS auto_merge, count(*) FILTER (routing = 'review') AS review, count(*) FILTER (routing = 'separate') AS separate FROM v_labelled GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return E.confusion(view(spark, sf_dir, "v_labelled"))


@query("""SELECT count(*) AS cases, avg(CASE WHEN routing = expected_routing THEN 1e0 ELSE 0e0 END) AS routing_accuracy, count(*) FILTER (routing = 'auto_merge' AND truth = 'same') / nullif(count(*) FILTER (routing = 'auto_merge'), 0)::DOUBLE AS auto_merge_precision,
  count(*) FILTER (routing = 'auto_merge' AND truth = 'same') / nullif(count(*) FILTER (truth = 'same'), 0)::DOUBLE AS auto_merge_recall, count(*) FILTER (routing = 'separate' AND truth = 'different') / nullif(count(*) FILTER (routing = 'separate'), 0)::DOUBLE AS separate_precision,
  avg(CASE WHEN routing = 'review' THEN 1e0 ELSE 0e0 END) AS review_rate, count(*) FILTER (routing = 'auto_merge' AND truth = 'different') AS false_merges_different, count(*) FILTER (routing = 'auto_merge' AND truth = 'uncertain') AS false_merges_uncertain,
  count(*) FILTER (routing = 'auto_merge' AND truth <> 'same') AS false_merges, count(*) FILTER (routing = 'separate' AND truth = 'same') AS false_separates FROM v_labelled""")
def routing_metrics(spark, sf_dir):
    return E.metrics(view(spark, sf_dir, "v_labelled"))


@query("""SELECT 'truth' AS dimension, truth AS value, count(*) AS cases, avg(CASE WHEN routing = expected_routing THEN 1e0 ELSE 0e0 END) AS accuracy FROM v_labelled GROUP BY truth
  UNION ALL SELECT 'difficulty', difficulty, count(*), avg(CASE WHEN routing = expected_routing THEN 1e0 ELSE 0e0 END) FROM v_labelled GROUP BY difficulty""")
def accuracy_by_group(spark, sf_dir):
    return E.accuracy_by(view(spark, sf_dir, "v_labelled"), "truth", "difficulty")


@query("""SELECT 'truth' AS dimension, truth AS value, count(*) AS n FROM v_labelled GROUP BY 2 UNION ALL SELECT 'expected_routing', expected_routing, count(*) FROM v_labelled GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*) FROM v_labelled GROUP BY 2""")
def labelled_summary(spark, sf_dir):
    return E.dataset_summary(view(spark, sf_dir, "v_labelled").select("case_id", "truth", "expected_routing", "difficulty"))


@query("SELECT 'holdout' AS part, count(*) FILTER (CAST(case_id AS INT) % 10 = 0) AS cases FROM v_labelled UNION ALL SELECT 'calibration', count(*) FILTER (CAST(case_id AS INT) % 10 <> 0) FROM v_labelled")
def partition_counts(spark, sf_dir):
    cases = view(spark, sf_dir, "v_labelled")
    held = cases.where("cast(case_id as int) % 10 = 0").select("case_id")
    parts = [E.partition(cases, n, held).agg(F.count("*").alias("cases")).select(F.lit(n).alias("part"), "cases") for n in ("holdout", "calibration")]
    return parts[0].unionByName(parts[1])


@query("SELECT case_id, truth, expected_routing, routing FROM v_labelled WHERE routing <> expected_routing")
def incorrect_cases(spark, sf_dir):
    return E.incorrect(view(spark, sf_dir, "v_labelled")).select("case_id", "truth", "expected_routing", "routing")


@query("""SELECT count(*) FILTER (routing = 'auto_merge' AND truth = 'different') = 0 AS no_false_merge, count(*) FILTER (routing = 'auto_merge' AND truth = 'uncertain') = 0 AS no_uncertain_merge,
  count(*) FILTER (routing = 'auto_merge' AND difficulty = 'hard') = 0 AS no_ineligible_merge, count(*) FILTER (case_id = '9' AND routing <> 'review') = 0 AS named_case_in_review FROM v_labelled""")
def safety_gates(spark, sf_dir):
    return E.gates(view(spark, sf_dir, "v_labelled").withColumn("eligible", F.col("difficulty") != "hard"), "9")


@query(f"SELECT doc_id, array_to_string(list_sort([CASE WHEN doc_id % 3 = 0 THEN 'date' ELSE 'timed' END, CASE WHEN doc_id % 6 = 0 THEN 'date-range' ELSE 'timed' END]), '-vs-') AS pairing FROM v_events")
def temporal_pairing(spark, sf_dir):
    d = F.col("doc_id")
    return view(spark, sf_dir, "v_events").select("doc_id", E.temporal_pairing(F.when(d % 3 == 0, "date").otherwise("timed"), F.when(d % 6 == 0, "date-range").otherwise("timed")).alias("pairing"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'maybe' ELSE 'same' END AS truth, doc_id % 40 = 0 AS no_tags FROM documents)
  SELECT 'unknown_truth' AS code, CAST(doc_id AS VARCHAR) AS key FROM d WHERE truth = 'maybe' UNION ALL SELECT 'empty_tags', CAST(doc_id AS VARCHAR) FROM d WHERE no_tags
  UNION ALL SELECT 'truth_not_covered', unnest(['different', 'uncertain']) UNION ALL SELECT 'routing_not_covered', unnest(['review', 'separate']) UNION ALL SELECT 'kind_not_covered', 'date-range'""")
def dataset_validation(spark, sf_dir):
    d = F.col("doc_id")
    side = lambda p, kind: F.struct(F.concat(F.lit(p), d.cast("string")).alias("id"), F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("date").alias("endDate")).alias("occurrence"))
    tags = F.when(d % 40 != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    cases = view(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"), side("l", "timed").alias("left"), side("r", "date").alias("right"), F.when(d % 50 == 0, "maybe").otherwise("same").alias("identityTruth"), F.lit("auto_merge").alias("expectedRouting"), F.lit("easy").alias("difficulty"),
        F.array(F.lit("date_conflict")).alias("criticalConflicts"), F.lit("why").alias("rationale"), tags.alias("tags"),
    )
    return E.dataset_errors(cases)


