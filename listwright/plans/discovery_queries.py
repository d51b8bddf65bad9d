"""Registered queries of the text, time and place functions and of discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions import geo, temporal, text
from listwright.operators import discover as D

from .catalog import OCC, query, sql_local_date, sql_normal, sql_similarity, sql_slug, sql_stamp, sql_token_similarity, sql_tokens, sql_trigrams, sql_word_similarity, stamp
from .views import view

START, END = "2024-01-02", "2024-01-04"
MATCH = f"""{OCC},
  m AS (SELECT event_id, min(instant) AS sort_instant FROM occ WHERE first_day <= DATE '{END}' AND last_day >= DATE '{START}' GROUP BY event_id),
  ev AS (SELECT e.*, m.sort_instant, v.name AS venue_name, v.latitude, v.longitude FROM v_events e JOIN m ON m.event_id = e.id LEFT JOIN v_venues v ON v.id = e.venue_id)"""
ALL = f"""{OCC},
  m AS (SELECT event_id, min(instant) AS sort_instant FROM occ GROUP BY event_id),
  ev AS (SELECT e.*, m.sort_instant, v.name AS venue_name, v.latitude, v.longitude FROM v_events e JOIN m ON m.event_id = e.id LEFT JOIN v_venues v ON v.id = e.venue_id)"""


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(view(spark, sf_dir, n) for n in ("v_events", "v_occurrences", "v_venues"))


@query(f"WITH {MATCH} SELECT id, {sql_stamp('sort_instant')} AS sort_instant FROM ev WHERE status = 'scheduled'")
def discover_date_range(spark, sf_dir):
    rows = D.found(*tables(spark, sf_dir), D.Request(start=START, end=END))
    return rows.select("id", stamp("sort_instant").alias("sort_instant"))


@query(f"WITH {MATCH} SELECT id, title, {sql_stamp('ev.sort_instant')} AS sort_instant FROM ev WHERE status = 'scheduled' ORDER BY ev.sort_instant, id LIMIT 20")
def discover_soonest_topk(spark, sf_dir):
    rows = D.discover(*tables(spark, sf_dir), D.Request(start=START, end=END))
    return rows.select("id", "title", stamp("sort_instant").alias("sort_instant"))


@query(f"WITH {MATCH} SELECT id, {sql_stamp('ev.sort_instant')} AS sort_instant FROM ev WHERE status = 'scheduled' AND (ev.sort_instant > TIMESTAMP '2024-01-03 12:00:00' OR (ev.sort_instant = TIMESTAMP '2024-01-03 12:00:00' AND id > '5')) ORDER BY ev.sort_instant, id LIMIT 20")
def discover_keyset_page(spark, sf_dir):
    rows = D.discover(*tables(spark, sf_dir), D.Request(start=START, end=END, after=("2024-01-03 12:00:00", "5")))
    return rows.select("id", stamp("sort_instant").alias("sort_instant"))


@query(f"""WITH {MATCH}, f AS (SELECT ev.sort_instant AS t, id FROM ev WHERE status = 'scheduled' ORDER BY ev.sort_instant, id LIMIT 21),
  n AS (SELECT *, row_number() OVER (ORDER BY t, id) AS k FROM f)
  SELECT (SELECT count(*) FROM f) > 20 AS has_more, {sql_stamp('t')} AS next_instant, id AS next_id FROM n WHERE k = 20""")
def discover_next_key(spark, sf_dir):
    request = D.Request(start=START, end=END)
    _, key = D.page(D.found(*tables(spark, sf_dir), request), request)
    return key.select("has_more", stamp("next_key.sort_instant").alias("next_instant"), F.col("next_key.id").alias("next_id"))


@query(f"WITH {ALL} SELECT id, {sql_stamp('sort_instant')} AS sort_instant FROM ev WHERE status = 'postponed' AND category_id = 'fr'")
def discover_category_status(spark, sf_dir):
    rows = D.found(*tables(spark, sf_dir), D.Request(status="postponed", category="fr"))
    return rows.select("id", stamp("sort_instant").alias("sort_instant"))


@query("SELECT id, free FROM v_events WHERE status = 'scheduled' AND free IS TRUE UNION ALL SELECT id, free FROM v_events WHERE status = 'scheduled' AND free IS FALSE")
def discover_price_tristate(spark, sf_dir):
    events, occurrences, venues = tables(spark, sf_dir)
    asked = [D.found(events, occurrences, venues, D.Request(free=x)).select("id", "free") for x in (True, False)]
    return asked[0].unionByName(asked[1])


@query(f"WITH {MATCH} SELECT id, {sql_stamp('ev.sort_instant')} AS sort_instant FROM ev WHERE status = 'scheduled' AND doc_id % 7 <> 0 ORDER BY ev.sort_instant, id LIMIT 12")
def discover_exclude(spark, sf_dir):
    events, occurrences, venues = tables(spark, sf_dir)
    hidden = events.where("doc_id % 7 = 0").select("id")
    rows = D.discover(events, occurrences, venues, D.Request(start=START, end=END, limit=12), hidden)
    return rows.select("id", stamp("sort_instant").alias("sort_instant"))


@query(f"""WITH {ALL}, g AS (SELECT *, {sql_trigrams("'small rings'")} AS q, {sql_trigrams('title')} AS t, {sql_trigrams("coalesce(venue_name, '')")} AS v FROM ev WHERE status = 'scheduled')
  SELECT id FROM g WHERE contains(lower(title), 'small rings') OR contains(lower(description), 'small rings') OR contains(lower(coalesce(venue_name, '')), 'small rings')
    OR {sql_word_similarity('q', 't')} > 0.3 OR {sql_word_similarity('q', 'v')} > 0.3""")
def discover_text_search(spark, sf_dir):
    return D.found(*tables(spark, sf_dir), D.Request(q="small rings")).select("id")


LAMBERT = """round(CASE WHEN angle = 0 THEN 0e0 ELSE 6378137e0 * (angle - (1 / 298.257223563e0) / 2 * (
    (angle - sin(angle)) * pow(sin(p) * cos(q), 2) / pow(cos(angle / 2), 2) + (angle + sin(angle)) * pow(cos(p) * sin(q), 2) / pow(sin(angle / 2), 2))) END, 3)"""


def sql_lambert(head: str, rows: str, lat: str, lng: str) -> str:
    """CTEs after `head` that add distance_meters to `rows`, which have latitude and longitude."""
    return f"""{head}, red AS (SELECT *, atan((1 - 1 / 298.257223563e0) * tan(radians(latitude))) AS b1, atan((1 - 1 / 298.257223563e0) * tan(radians({lat}))) AS b2 FROM {rows}),
  ang AS (SELECT *, (b1 + b2) / 2 AS p, (b2 - b1) / 2 AS q, 2 * asin(least(1e0, sqrt(pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin(radians({lng} - longitude) / 2), 2)))) AS angle FROM red),
  far AS (SELECT *, {LAMBERT} AS distance_meters FROM ang)"""


@query(sql_lambert(f"WITH {ALL}, own AS (SELECT * FROM ev WHERE status = 'scheduled')", "own", "-30.005e0", "-51.205e0") + " SELECT id, distance_meters FROM far WHERE distance_meters <= 1500")
def discover_nearby(spark, sf_dir):
    rows = D.found(*tables(spark, sf_dir), D.Request(lat=-30.005, lng=-51.205, radius=1500))
    return rows.select("id", F.round("distance_meters", 3).alias("distance_meters"))


@query(f"WITH {ALL} SELECT id, {sql_stamp('sort_instant')} AS sort_instant FROM ev WHERE status = 'scheduled'")
def discover_full_scan(spark, sf_dir):
    return D.full_scan(*tables(spark, sf_dir)).select("id", stamp("sort_instant").alias("sort_instant"))


@query("SELECT DISTINCT category_id FROM v_events WHERE category_id IS NOT NULL")
def category_ids(spark, sf_dir):
    from listwright.operators.store import categories

    return categories(view(spark, sf_dir, "v_events"))


def sql_resembles(a: str, b: str) -> str:
    """Run similarity above 0.3, which needs more than that share of the first list's trigrams."""
    return f"CASE WHEN len(list_intersect({a}, {b})) <= 0.3 * len(list_distinct({a})) THEN false ELSE {sql_word_similarity(a, b)} > 0.3 END"


TEXT = f"""CASE WHEN contains(lower(e.title), r.q) OR contains(lower(e.description), r.q) OR coalesce(contains(lower(v.name), r.q), false) THEN true
      ELSE {sql_resembles(sql_trigrams('r.q'), sql_trigrams('e.title'))} OR {sql_resembles(sql_trigrams('r.q'), sql_trigrams("coalesce(v.name, '')"))} END"""
REQUESTS = """SELECT s_suppkey AS request_id, CAST(1 + s_suppkey % 9 AS INT) AS "limit", CASE WHEN s_suppkey % 3 <> 0 THEN make_date(2024, 1, CAST(1 + s_suppkey % 9 AS INT)) END AS "start",
  CASE WHEN s_suppkey % 3 <> 0 THEN make_date(2024, 1, CAST(1 + s_suppkey % 9 + s_suppkey % 4 AS INT)) END AS "end", CASE WHEN s_suppkey % 5 = 0 THEN 'postponed' ELSE 'scheduled' END AS status,
  CASE WHEN s_suppkey % 4 = 0 THEN 'de' END AS category, CASE WHEN s_suppkey % 7 = 0 THEN true END AS free, CASE WHEN s_suppkey % 2 = 0 THEN -30.0e0 - s_suppkey / 10000e0 END AS lat,
  CASE WHEN s_suppkey % 2 = 0 THEN -51.2e0 END AS lng, CASE WHEN s_suppkey % 2 = 0 THEN 1000 + s_suppkey END AS radius, CASE WHEN s_suppkey % 20 = 3 THEN 'ring de src' || CAST(s_suppkey % 7 AS STRING) WHEN s_suppkey % 40 = 4 THEN 'brazil' END AS q FROM supplier"""


@query(
    sql_lambert(
        f"""WITH {OCC}, req AS ({REQUESTS}), hit AS (
    SELECT r.request_id, o.event_id, min(o.instant) AS sort_instant FROM req r JOIN occ o ON r."start" IS NULL OR (o.first_day <= r."end" AND o.last_day >= r."start") GROUP BY ALL),
  own AS (SELECT r.* EXCLUDE (q), e.id, h.sort_instant, v.latitude, v.longitude FROM hit h JOIN req r ON r.request_id = h.request_id JOIN v_events e ON e.id = h.event_id LEFT JOIN v_venues v ON v.id = e.venue_id
    WHERE e.status = r.status AND (r.category IS NULL OR r.category = e.category_id) AND (r.free IS NULL OR r.free = e.free) AND (r.q IS NULL OR {TEXT}))""",
        "own", "lat", "lng",
    )
    + f""", ok AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY distance_meters NULLS FIRST, sort_instant, id) AS INTEGER) AS rank FROM far WHERE lat IS NULL OR distance_meters <= radius)
  SELECT request_id, rank, id, {sql_stamp('sort_instant')} AS sort_instant, distance_meters FROM ok WHERE rank <= "limit" """
)
def discover_batch_requests(spark, sf_dir):
    own = spark.sql(REQUESTS.replace('"', "`").replace("FROM supplier", "FROM {s}"), s=view(spark, sf_dir, "supplier"))
    params = own.select("request_id", F.struct(*(c for c in own.columns if c != "request_id")).alias("params"))
    rows = D.discover_batch(*tables(spark, sf_dir), params)
    return rows.select("request_id", "rank", "id", stamp("sort_instant").alias("sort_instant"), F.round("distance_meters", 3).alias("distance_meters"))


RAW_REQUESTS = """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 130 AS STRING) END AS "limit",
  CASE c_custkey % 11 WHEN 1 THEN 'today' WHEN 2 THEN 'weekend' WHEN 3 THEN 'this_month' WHEN 4 THEN 'someday' WHEN 5 THEN 'this_week' WHEN 6 THEN 'tomorrow' END AS period,
  CASE c_custkey % 13 WHEN 1 THEN '2026-02-01' WHEN 2 THEN '2026-02-30' WHEN 3 THEN '2026-2-1' WHEN 4 THEN '2026-03-09' END AS "start",
  CASE c_custkey % 13 WHEN 1 THEN '2026-02-03' WHEN 2 THEN '2026-03-01' WHEN 3 THEN '2026-03-01' WHEN 4 THEN '2026-03-01' WHEN 5 THEN '2026-03-01' END AS "end",
  CASE c_custkey % 17 WHEN 1 THEN 'true' WHEN 2 THEN 'false' WHEN 3 THEN 'yes' END AS free, CASE c_custkey % 19 WHEN 1 THEN 'cancelled' WHEN 2 THEN 'gone' END AS status,
  CASE c_custkey % 23 WHEN 1 THEN '-30.03' WHEN 2 THEN '-91' WHEN 3 THEN 'x' WHEN 4 THEN '-30.03' END AS lat, CASE c_custkey % 23 WHEN 1 THEN '-51.2' WHEN 2 THEN '-51.2' WHEN 3 THEN '-51.2' WHEN 5 THEN '-51.2' END AS lng,
  CASE c_custkey % 29 WHEN 1 THEN '500' WHEN 2 THEN '60000' WHEN 3 THEN '10.5' END AS radius, CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS q FROM customer"""
DATE_OK = "(regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast({0} AS DATE) IS NOT NULL)"


@query(f"""WITH r AS ({RAW_REQUESTS}), e AS (SELECT *, CASE
    WHEN coalesce(CAST("limit" AS INT), 20) NOT BETWEEN 1 AND 100 THEN 'invalid-limit'
    WHEN period IS NOT NULL AND ("start" IS NOT NULL OR "end" IS NOT NULL) THEN 'invalid-filter-combination'
    WHEN period IS NOT NULL AND period NOT IN ('today', 'tomorrow', 'weekend', 'this_week', 'this_month') THEN 'invalid-period'
    WHEN period IS NULL AND ("start" IS NULL) <> ("end" IS NULL) THEN 'invalid-filter-combination'
    WHEN "start" IS NOT NULL AND NOT ({DATE_OK.format('"start"')} AND {DATE_OK.format('"end"')}) THEN 'invalid-date'
    WHEN "start" > "end" THEN 'invalid-date'
    WHEN free NOT IN ('true', 'false') THEN 'invalid-query-parameter'
    WHEN status NOT IN ('scheduled', 'cancelled', 'postponed', 'rescheduled', 'completed') THEN 'invalid-query-parameter'
    WHEN (lat IS NOT NULL OR lng IS NOT NULL OR radius IS NOT NULL) AND (lat IS NULL OR lng IS NULL) THEN 'invalid-location'
    WHEN lat IS NOT NULL AND NOT coalesce(try_cast(lat AS DOUBLE) BETWEEN -90 AND 90 AND try_cast(lng AS DOUBLE) BETWEEN -180 AND 180, false) THEN 'invalid-location'
    WHEN lat IS NOT NULL AND NOT (coalesce(try_cast(radius AS DOUBLE), 5000) BETWEEN 1 AND 50000 AND coalesce(try_cast(radius AS DOUBLE), 5000) % 1 = 0) THEN 'invalid-radius' END AS error_code FROM r)
  SELECT request_id, error_code, CASE WHEN error_code IS NULL THEN CAST(CASE period WHEN 'today' THEN DATE '2026-01-04' WHEN 'tomorrow' THEN DATE '2026-01-05' WHEN 'weekend' THEN DATE '2026-01-03'
      WHEN 'this_week' THEN DATE '2025-12-29' WHEN 'this_month' THEN DATE '2026-01-01' ELSE CAST("start" AS DATE) END AS VARCHAR) END AS first_day,
    CASE WHEN error_code IS NULL THEN CAST(CASE period WHEN 'today' THEN DATE '2026-01-04' WHEN 'tomorrow' THEN DATE '2026-01-05' WHEN 'weekend' THEN DATE '2026-01-04'
      WHEN 'this_week' THEN DATE '2026-01-04' WHEN 'this_month' THEN DATE '2026-01-31' ELSE CAST("end" AS DATE) END AS VARCHAR) END AS last_day,
    CASE WHEN error_code IS NULL THEN CAST(coalesce(CAST("limit" AS INT), 20) AS INTEGER) END AS row_limit FROM e""")
def request_validation(spark, sf_dir):
    own = spark.sql(RAW_REQUESTS.replace('"', "`").replace("FROM customer", "FROM {c}"), c=view(spark, sf_dir, "customer"))
    # a Sunday evening in the listings' zone, already Monday in UTC
    rows = D.validated(own, F.lit("2026-01-05 02:00:00").cast("timestamp"))
    return rows.select("request_id", "error_code", F.col("params.start").cast("string").alias("first_day"), F.col("params.end").cast("string").alias("last_day"), F.col("params.limit").alias("row_limit"))


@query(f"SELECT id, {sql_normal('description')} AS normal, list_sort({sql_tokens('description')}) AS tokens_list, CAST(len({sql_tokens('description')}) AS INTEGER) AS tokens FROM v_events".replace(f"list_sort({sql_tokens('description')}) AS tokens_list", f"array_to_string(list_sort({sql_tokens('description')}), ' ') AS significant"))
def text_normalize(spark, sf_dir):
    words = F.col("description")
    tokens = text.significant_tokens(words)
    return view(spark, sf_dir, "v_events").select("id", text.normalize_text(words).alias("normal"), F.array_join(F.array_sort(tokens), " ").alias("significant"), F.size(tokens).alias("tokens"))


@query(f"SELECT id, {sql_slug('description')} AS slug, CASE WHEN {sql_slug('description')} = '' THEN '' ELSE {sql_slug('description')} || '-' END || substr(sha256(source_id || ':' || id), 1, 8) AS event_slug FROM v_events")
def slug_build(spark, sf_dir):
    return view(spark, sf_dir, "v_events").select("id", text.slug(F.col("description")).alias("slug"), text.event_slug(F.col("description"), F.col("source_id"), F.col("id")).alias("event_slug"))


@query("""SELECT page_id, regexp_replace(lower(trim(url)), '/+$', '') AS normal, regexp_matches(lower(url), '^https?://[^/]') AS is_http,
  coalesce(CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) END, nullif(regexp_extract(url, '/([^/]+)/?$', 1), '')) AS external_id FROM pages""")
def url_external_id(spark, sf_dir):
    pages = view(spark, sf_dir, "pages")
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), F.col("page_id").cast("string"), F.lit(" ")))
    last = F.concat(F.lit("https://x.example/evento/"), F.regexp_extract("url", "/([^/]+)/?$", 1), F.lit("/"))
    return pages.select("page_id", text.normalize_url(F.col("url")).alias("normal"), text.is_http_url(F.col("url")).alias("is_http"), text.external_id_of(given, last).alias("external_id"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts a and b of documents beside each other, and their titles."""
    x = view(spark, sf_dir, "v_events")
    left = x.select("doc_id", F.col("description").alias("a"), F.col("title").alias("title_a"))
    return left.join(x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("description").alias("b"), F.col("title").alias("title_b")), "doc_id")


PAIRS = "p AS (SELECT x.doc_id, x.description AS a, y.description AS b, x.title AS title_a, y.title AS title_b FROM v_events x JOIN v_events y ON y.doc_id = x.doc_id + 1)"
TRIGRAMS = ", ".join(f"{sql_trigrams(c)} AS {n}" for c, n in (("a", "x"), ("b", "y"), ("title_a", "v"), ("title_b", "w")))


@query(f"WITH {PAIRS}, t AS (SELECT doc_id, {sql_tokens('a')} AS x, {sql_tokens('b')} AS y FROM p) SELECT doc_id, round({sql_token_similarity('x', 'y')}, 9) AS similarity FROM t")
def token_similarity(spark, sf_dir):
    return neighbours(spark, sf_dir).select("doc_id", F.round(text.token_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(f"WITH {PAIRS}, t AS (SELECT doc_id, {TRIGRAMS} FROM p) SELECT doc_id, round({sql_similarity('x', 'y')}, 9) AS similarity, round({sql_word_similarity('v', 'w')}, 9) AS word_similarity FROM t")
def trigram_similarity(spark, sf_dir):
    """The plain similarity of whole texts, that of runs of titles."""
    plain, runs = text.similarity(F.col("a"), F.col("b")), text.word_similarity(F.col("title_a"), F.col("title_b"))
    return neighbours(spark, sf_dir).select("doc_id", F.round(plain, 9).alias("similarity"), F.round(runs, 9).alias("word_similarity"))


DATES = "SELECT o_orderkey, CAST(2020 + o_orderkey % 9 AS STRING) || '-' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '0' END || CAST(1 + o_orderkey % 9 AS STRING) || '-' || CAST(10 + o_orderkey % 23 AS STRING) AS d FROM orders"


@query(f"WITH x AS ({DATES}) SELECT o_orderkey, {DATE_OK.format('d')} AS is_date, regexp_extract('Feira ' || d || ' x', '\\b(19|20)\\d{{2}}\\b', 0) AS year FROM x")
def calendar_dates(spark, sf_dir):
    rows = spark.sql(DATES.replace("FROM orders", "FROM {o}"), o=view(spark, sf_dir, "orders"))
    return rows.select("o_orderkey", temporal.is_calendar_date(F.col("d")).alias("is_date"), text.year_token(F.concat(F.lit("Feira "), F.col("d"), F.lit(" x"))).alias("year"))


@query(f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 HOUR AS now FROM orders), t AS (SELECT now, {sql_local_date('now')} AS d FROM d)
  SELECT {sql_stamp('now')} AS now, CAST(d AS VARCHAR) AS today, CAST(d + 1 AS VARCHAR) AS tomorrow, CAST(CAST(date_trunc('week', d) AS DATE) + 5 AS VARCHAR) AS saturday, CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS monday,
    CAST(CAST(date_trunc('week', d) AS DATE) + 6 AS VARCHAR) AS sunday, CAST(CAST(date_trunc('month', d) AS DATE) AS VARCHAR) AS month_start, CAST(last_day(d) AS VARCHAR) AS month_end FROM t""")
def period_ranges(spark, sf_dir):
    now = F.col("now")
    rows = view(spark, sf_dir, "orders").select((F.col("o_orderdate").cast("timestamp") + F.expr("interval 2 hours")).alias("now")).distinct()
    r = {p: temporal.period_range(F.lit(p), now) for p in temporal.PERIODS}
    own = {"today": r["today"]["end"], "tomorrow": r["tomorrow"]["start"], "saturday": r["weekend"]["start"], "monday": r["this_week"]["start"], "sunday": r["this_week"]["end"], "month_start": r["this_month"]["start"], "month_end": r["this_month"]["end"]}
    return rows.select(stamp("now").alias("now"), *(c.cast("string").alias(k) for k, c in own.items()))


@query(f"WITH {OCC} SELECT id, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, {sql_stamp('instant')} AS instant FROM occ")
def local_dates(spark, sf_dir):
    c = F.col
    occ = view(spark, sf_dir, "v_occurrences")
    none = F.lit(None).cast("timestamp")
    return occ.select(
        "id", temporal.local_start(c("temporal_kind"), c("starts_at"), c("start_date")).cast("string").alias("first_day"),
        temporal.local_end(c("temporal_kind"), c("starts_at"), none, c("start_date"), c("end_date")).cast("string").alias("last_day"),
        stamp(temporal.effective_instant(c("temporal_kind"), c("starts_at"), c("start_date"))).alias("instant"),
    )


@query("""WITH p AS (SELECT a.id AS a, b.id AS b, a.latitude AS la, a.longitude AS lo, b.latitude AS lb, b.longitude AS lp FROM v_venues a JOIN v_venues b ON b.id = a.id + 1)
  SELECT a, b, CASE WHEN la IS NOT NULL AND lo IS NOT NULL AND lb IS NOT NULL AND lp IS NOT NULL THEN round(2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * pow(sin(radians(lp - lo) / 2), 2)))), 3) END AS metres FROM p""")
def sphere_distance(spark, sf_dir):
    v = view(spark, sf_dir, "v_venues")
    b = v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("latitude").alias("lb"), F.col("longitude").alias("lp"))
    rows = v.select(F.col("id").alias("a"), F.col("latitude").alias("la"), F.col("longitude").alias("lo")).join(b, "a")
    return rows.select("a", "b", F.round(geo.haversine(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp")), 3).alias("metres"))
