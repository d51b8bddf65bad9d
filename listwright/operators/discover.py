"""Discovery: filters, text search, radius, order, keyset pages; for one request or a table of them.

Tables: events (id, title, description, category_id, status, free, venue_id), occurrences (event_id, temporal_kind,
starts_at, ends_at, start_date, end_date), venues (id, name, latitude, longitude). All filters stand before the
aggregation or the join, so they reach the scans; a page is a top-k of ids and only its rows get their children.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listwright.functions.geo import ellipsoidal, within_box
from listwright.functions.temporal import PERIODS, date_range, date_range_error, effective_instant, local_end, local_start
from listwright.functions.text import contains_ignore_case, let, substring_grams, term_grams, trigrams, word_similar
from listwright.operators.export import public_rows
from listwright.operators.normalize import STATUSES
from listwright.operators.store import hydrate, in_clustered_range

# Bounds and defaults of a request, and the least word similarity.
LIMIT, MAX_LIMIT, RADIUS, MIN_RADIUS, MAX_RADIUS, LEAST_WORD_SIMILARITY = 20, 100, 5000, 1, 50000, 0.3


@dataclass(frozen=True)
class Request:
    """One discovery request. `after` is the key of the last row seen: (instant, id), or (distance, instant, id)."""

    start: date | str | None = None
    end: date | str | None = None
    status: str = "scheduled"
    category: str | None = None
    free: bool | None = None
    q: str | None = None
    lat: float | None = None
    lng: float | None = None
    radius: float = RADIUS
    limit: int = LIMIT
    after: tuple | None = None


def matching(occurrences: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(event_id, sort_instant): the earliest instant of the occurrences whose local dates meet the range.

    Occurrences as `store.write_occurrences` stores them are read only where the range may be met.
    """
    c = F.col
    own = occurrences
    if "ends_at" not in own.columns:
        own = own.withColumn("ends_at", F.lit(None).cast("timestamp"))
    if start is not None:
        if {"utc_first", "utc_last", "utc_week", "lasting"} <= set(own.columns):
            own = own.where(in_clustered_range(start, end))
        first, last = local_start(c("temporal_kind"), c("starts_at"), c("start_date")), local_end(c("temporal_kind"), c("starts_at"), c("ends_at"), c("start_date"), c("end_date"))
        own = own.where((first <= end) & (last >= start))
    return own.groupBy("event_id").agg(F.min(effective_instant(c("temporal_kind"), c("starts_at"), c("start_date"))).alias("sort_instant"))


def text_match(term: Column, title: Column, description: Column, venue_name: Column, performers: Column | None = None) -> Column:
    """Substring of title, description, venue or a performer's name, whatever the case, or a similar run of words in
    title or venue. Wildcards aren't special. Rows that contain the term aren't compared."""
    found = contains_ignore_case(title, term) | F.coalesce(contains_ignore_case(description, term), F.lit(False)) | F.coalesce(contains_ignore_case(venue_name, term), F.lit(False))
    if performers is not None:
        found = found | F.coalesce(F.exists(performers, lambda p: contains_ignore_case(p["name"], term)), F.lit(False))
    similar = word_similar(term, title, LEAST_WORD_SIMILARITY) | F.coalesce(word_similar(term, venue_name, LEAST_WORD_SIMILARITY), F.lit(False))
    return found | similar


def filtered_events(events: DataFrame, request: Request) -> DataFrame:
    own = events.where(F.col("status") == request.status)
    if request.category is not None:
        own = own.where(F.col("category_id") == request.category)
    if request.free is not None:
        own = own.where(F.col("free").eqNullSafe(F.lit(request.free)))
    return own


def order_key(geo: bool) -> list[str]:
    return [*(["distance_meters"] if geo else []), "sort_instant", "id"]


def after_key(columns: list[str], key: tuple) -> Column:
    if len(key) != len(columns):
        raise ValueError(f"a key of {columns} is needed, not of {len(key)} values")
    kinds = {"distance_meters": "double", "sort_instant": "timestamp", "id": "string"}
    return F.struct(*columns) > F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(columns, key, strict=True)))


def found(events: DataFrame, occurrences: DataFrame, venues: DataFrame, request: Request, suppressed: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """All rows of a request, without order and limit: events' columns, sort_instant, venue_name, distance_meters.

    index: a stored `text_index`, which a request with a text asks first.
    """
    day = lambda x: F.lit(x).cast("date")
    rows = filtered_events(events, request)
    rows = rows.join(matching(occurrences, *((day(request.start), day(request.end)) if request.start else ())).withColumnRenamed("event_id", "id"), "id")
    places = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name"), "latitude", "longitude")
    geo = request.lat is not None
    if geo:
        lat, lng, radius = F.lit(request.lat), F.lit(request.lng), F.lit(float(request.radius))
        distance = ellipsoidal(F.col("latitude"), F.col("longitude"), lat, lng)
        places = places.where(within_box(F.col("latitude"), F.col("longitude"), lat, lng, radius)).withColumn("distance_meters", distance).where(F.col("distance_meters") <= radius)
    rows = rows.join(places, "venue_id", "inner" if geo else "left")
    if request.q:
        if index is not None:
            rows = rows.join(with_text(index, request.q), "id", "left_semi")
        performers = F.col("performers") if "performers" in events.columns else None
        rows = rows.where(text_match(F.lit(request.q), F.col("title"), F.col("description"), F.col("venue_name"), performers))
    if suppressed is not None:
        rows = rows.join(suppressed.select("id"), "id", "left_anti")
    return rows


def page(rows: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
    """(the page's rows in order, (has_more, next key) as one row): limit + 1 rows are read, the last only as a sign.

    The request runs once, here: the driver gets those rows, MAX_LIMIT + 1 at most, and both results are made of them.
    """
    key = order_key(request.lat is not None)
    if request.after:
        rows = rows.where(after_key(key, request.after))
    spark = rows.sparkSession
    top = rows.orderBy(*key).limit(request.limit + 1).toArrow()
    shown = spark.createDataFrame(top.slice(0, request.limit), rows.schema)
    more = F.lit(top.num_rows > request.limit)
    last = spark.createDataFrame(top.slice(request.limit - 1, 1), rows.schema).agg(F.first(F.struct(*key)).alias("key"))
    return shown, last.select(more.alias("has_more"), F.when(more, F.col("key")).alias("next_key"))


def discover(events: DataFrame, occurrences: DataFrame, venues: DataFrame, request: Request, suppressed: DataFrame | None = None) -> DataFrame:
    """One page in order."""
    rows = found(events, occurrences, venues, request, suppressed)
    key = order_key(request.lat is not None)
    if request.after:
        rows = rows.where(after_key(key, request.after))
    return rows.orderBy(*key).limit(request.limit)


def public_page(events: DataFrame, occurrences: DataFrame, venues: DataFrame, refs: DataFrame, request: Request, suppressed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(one page of public rows with their position pos, (has_more, next key)): suppressed events go before the page is
    cut, and only the page's rows, at most its limit, get their children. Order by pos.

    events, venues and refs have the columns that `export.public_rows` shows.
    """
    extra = ["distance_meters"] if request.lat is not None else []
    key = order_key(request.lat is not None)
    rows, following = page(found(events, occurrences, venues, request, suppressed).select(*key), request)
    ids = rows.select("id", *extra, F.row_number().over(Window.orderBy(*key)).alias("pos"))  # a page's rows
    return public_rows(hydrate(events, occurrences, venues, refs, ids), "pos"), following


def full_scan(events: DataFrame, occurrences: DataFrame, venues: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """All visible events in order: what paging to the end would give, as one range-partitioned sort."""
    return found(events, occurrences, venues, Request(), suppressed).orderBy(*order_key(False))


def validated(requests: DataFrame, now: Column) -> DataFrame:
    """request_id, error_code and params of raw requests, all of whose columns but the id are text; absent is null."""
    c = F.col
    limit, radius = F.coalesce(c("limit"), F.lit(str(LIMIT))), F.coalesce(c("radius"), F.lit(str(RADIUS)))
    as_int = lambda x: F.when(x.try_cast("double") == F.floor(x.try_cast("double")), x.try_cast("double")).cast("long")
    within = lambda x, a, b: F.coalesce(x.between(a, b), F.lit(False))
    lat, lng = c("lat").try_cast("double"), c("lng").try_cast("double")
    has_geo = c("lat").isNotNull() | c("lng").isNotNull() | c("radius").isNotNull()
    error = (
        F.when(~within(as_int(limit), 1, MAX_LIMIT), "invalid-limit")
        .when(date_range_error(c("period"), c("start"), c("end")).isNotNull(), date_range_error(c("period"), c("start"), c("end")))
        .when(c("free").isNotNull() & ~c("free").isin("true", "false"), "invalid-query-parameter")
        .when(c("status").isNotNull() & ~c("status").isin(STATUSES), "invalid-query-parameter")
        .when(has_geo & (c("lat").isNull() | c("lng").isNull()), "invalid-location")
        .when(has_geo & ~(within(lat, -90, 90) & within(lng, -180, 180)), "invalid-location")
        .when(has_geo & ~within(as_int(radius), MIN_RADIUS, MAX_RADIUS), "invalid-radius")
    )
    span = date_range(c("period"), c("start"), c("end"), now)
    params = F.struct(
        as_int(limit).cast("int").alias("limit"), span["start"].alias("start"), span["end"].alias("end"), F.coalesce("status", F.lit("scheduled")).alias("status"), c("category"), F.nullif(c("q"), F.lit("")).alias("q"),
        (c("free") == "true").alias("free"), lat.alias("lat"), lng.alias("lng"), F.when(has_geo, as_int(radius)).alias("radius"),
    )
    return requests.select("request_id", error.alias("error_code"), F.when(error.isNull(), params).alias("params"))


#: Degrees of a grid cell, and days of a date bucket: what requests and events meet on.
CELL, WEEK = 0.25, 7


def week_of(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / WEEK)


def cell_of(degrees: Column) -> Column:
    return F.floor(degrees / CELL)


def meridian_cell(cell: Column) -> Column:
    """The cell of a longitude, the same on both sides of the date line."""
    return F.pmod(cell, F.lit(int(360 / CELL)))


def by_dates(asked: DataFrame, dated: DataFrame) -> DataFrame:
    """Ranges of dates (from, to, status) meet occurrences by status and by the weeks of local dates; equal ranges once:
    (from, to, id, sort_instant)."""
    c = F.col
    left = dated.withColumn("bucket", F.explode(F.sequence(week_of(c("first")), week_of(c("last")))))
    ranges = asked.where("`from` is not null").select("status", "from", "to").distinct()
    right = ranges.withColumn("bucket", F.explode(F.sequence(week_of(c("from")), week_of(c("to")))))
    hit = left.join(right, ["bucket", "status"]).where((c("first") <= c("to")) & (c("last") >= c("from")))
    return hit.groupBy("status", "from", "to", "id").agg(F.min("instant").alias("sort_instant"))


def by_cells(asked: DataFrame, places: DataFrame) -> DataFrame:
    """(request_id, place_id, distance_meters) of requests with a place and the places within their radius, which meet by
    grid cell; near the poles by cells of latitude."""
    c = F.col
    d_lat = c("radius") / 110000.0
    polar = F.abs("lat") + d_lat > 89.0
    d_lng = F.when(polar, 180.0).otherwise(c("radius") / (F.cos(F.radians(F.least(F.abs("lat") + d_lat, F.lit(89.0)))) * 110000.0))
    near = asked.where("lat is not null").select("request_id", "lat", "lng", "radius", d_lng.alias("d"), F.explode(F.sequence(cell_of(c("lat") - d_lat), cell_of(c("lat") + d_lat))).alias("row"))
    columns = F.array_distinct(F.transform(F.sequence(cell_of(c("lng") - c("d")), cell_of(c("lng") + c("d"))), meridian_cell))
    near = near.select("request_id", "lat", "lng", "radius", "row", F.explode(columns).alias("column"))
    placed = places.where("latitude is not null and longitude is not null").select("place_id", "latitude", "longitude", cell_of(c("latitude")).alias("row"), meridian_cell(cell_of(c("longitude"))).alias("column"))
    far = placed.join(near, ["row", "column"]).withColumn("distance_meters", ellipsoidal(c("latitude"), c("longitude"), c("lat"), c("lng")))
    return far.where(c("distance_meters") <= c("radius")).select("request_id", "place_id", "distance_meters")


# nearest first


#: Metres of the first ring, and how much wider each next one is. Half of the longest meridian is as far as it gets.
FIRST_RING, WIDER, FURTHEST = 1_000.0, 8.0, 20_040_000.0


def place_cell(lat: Column, lng: Column) -> Column:
    """A number of a Z-shaped curve over the globe, 16 bits for either direction: places of near numbers are near."""
    bits = F.lit(0).cast("long")
    y, x = (F.least(F.floor((c + half) / (2 * half) * 65536), F.lit(65535)).cast("long") for c, half in ((lat, 90), (lng, 180)))
    for i in range(16):
        for c, at in ((x, 2 * i), (y, 2 * i + 1)):
            bits = bits.bitwiseOR(F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1)), at))
    return bits


def write_places(places: DataFrame, path: str, files: int = 64) -> None:
    """Places along the curve, a stretch of it in each file: the least and greatest latitude and longitude that a file
    holds are close, so a box opens few of them. Places without coordinates are among them, at the curve's beginning."""
    cell = F.coalesce(place_cell(F.col("latitude"), F.col("longitude")), F.lit(-1).cast("long"))
    places.withColumn("cell", cell).repartitionByRange(files, "cell", "id").sortWithinPartitions("cell").write.parquet(path)


def nearest(places: DataFrame, lat: float, lng: float, k: int) -> DataFrame:
    """The k nearest places (id, latitude, longitude, ...), with distance_meters; nearest first, then by id.

    A ring is a box around the point, which reaches the scan, and the distance behind it. The ring that holds k places
    holds the k nearest; if it has fewer, the next is WIDER times as wide, up to the whole globe. The driver gets one
    count a ring.
    """
    radius = FIRST_RING
    while True:
        everywhere = radius >= FURTHEST
        own = places.where("latitude is not null and longitude is not null")
        if not everywhere:
            own = own.where(within_box(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lng), F.lit(radius)))
        rows = own.withColumn("distance_meters", ellipsoidal(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lng)))
        if not everywhere:
            rows = rows.where(F.col("distance_meters") <= radius)
        if everywhere or rows.limit(k).count() == k:
            return rows.orderBy("distance_meters", "id").limit(k)
        radius *= WIDER


# text requests


#: Folders of a stored index, whose grams are sorted within their files; grams of terms (some 40 bytes each) that may be
#: broadcast; terms that every text may be searched for.
INDEX_PARTS, FEW_GRAMS, FEW_TERMS = 64, 100_000, 500


def index_part(gram: Column) -> Column:
    return (F.crc32(gram.cast("binary")) % INDEX_PARTS).cast("int")


def whole_text(events: DataFrame, venues: DataFrame) -> DataFrame:
    """(id, title, venue_name, whole): all that a term may be in, parted by a character that it would have to have in it."""
    c = F.col
    places = venues.select(c("id").alias("venue_id"), c("name").alias("venue_name"))
    texts = [c("title"), c("description"), c("venue_name")]
    if "performers" in events.columns:
        texts.append(F.array_join(F.transform("performers", lambda p: p["name"]), "\n"))
    return events.join(places, "venue_id", "left").select("id", "title", "venue_name", F.concat_ws("\n", *(F.coalesce(x, F.lit("")) for x in texts)).alias("whole"))


def text_index(events: DataFrame, venues: DataFrame, kinds: tuple[str, ...] = ("has", "run", "place")) -> DataFrame:
    """Postings (kind, gram, id): `has` are the substring grams of an event's title, description, performers' names and
    venue's name; `run` are the trigrams, as similarity knows them, of its title (`run`) and its venue's name (`place`)."""
    c = F.col
    grams = {"has": substring_grams(c("whole")), "run": F.array_distinct(trigrams(c("title"))), "place": F.array_distinct(trigrams(c("venue_name")))}
    posted = (F.struct(F.lit(k).alias("kind"), F.coalesce(grams[k], F.array().cast("array<string>")).alias("grams")) for k in kinds)
    rows = whole_text(events, venues).select("id", F.explode(F.array(*posted)).alias("x"))
    return rows.select("x.kind", F.explode("x.grams").alias("gram"), "id")


def write_text_index(index: DataFrame, path: str) -> None:
    """Stores postings in INDEX_PARTS folders by gram, sorted: a reader of a few grams opens their folders' files only.

    A gram of very many events isn't one task's: rows are dealt by gram and event within a folder.
    """
    rows = index.withColumn("part", index_part(F.col("gram")))
    rows.repartitionByRange("part", "gram", "id").sortWithinPartitions("part", "gram", "kind", "id").write.partitionBy("part").parquet(path)


def grams_of(spark: SparkSession, term: str) -> tuple[list[str], list[str]]:
    """(substring grams, trigrams) of one term."""
    r = spark.range(1).select(term_grams(F.lit(term)).alias("has"), F.array_distinct(trigrams(F.lit(term))).alias("run")).first()
    return r["has"], r["run"]


def with_text(index: DataFrame, term: str) -> DataFrame:
    """(id) of events that may hold or resemble a term, by a stored index: its grams become filters of the scan."""
    has, run = grams_of(index.sparkSession, term)
    wanted = sorted({*has, *run})
    own = index.where(F.col("gram").isin(wanted))
    if "part" in index.columns:
        own = own.where(F.col("part").isin(sorted({zlib.crc32(g.encode()) % INDEX_PARTS for g in wanted})))
    asked = index.sparkSession.range(1).select(F.col("id").alias("request_id"), F.lit(term).alias("q"))
    return by_text(asked, own).select("id").distinct()


def by_text(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(request_id, id) of events that may hold a request's term q or resemble it; text_match decides.

    Who holds the term has all its grams, so the rarest one is looked up. Who resembles it shares more than
    LEAST_WORD_SIMILARITY of its trigrams, title and venue each by itself; these are counted, all but the most frequent
    ones that can't make up that share alone. Both are joins on a gram: a request meets only what is posted under its own.
    """
    c = F.col
    terms = asked.where("q is not null").select("request_id", "q")
    grams = terms.select("request_id", F.explode(F.array(F.struct(F.lit("has").alias("kind"), term_grams(c("q")).alias("g")), *(F.struct(F.lit(k).alias("kind"), F.array_distinct(trigrams(c("q"))).alias("g")) for k in ("run", "place")))).alias("x"))
    grams = grams.select("request_id", "x.kind", F.size("x.g").alias("n"), F.explode("x.g").alias("gram"))
    # the terms' grams go to the postings where they are few, so that these need no exchange
    few = F.broadcast if grams.count() <= FEW_GRAMS else lambda rows: rows
    counts = index.join(few(grams.select("kind", "gram").distinct()), ["kind", "gram"], "left_semi").groupBy("kind", "gram").count()
    order = Window.partitionBy("request_id", "kind").orderBy(F.coalesce("count", F.lit(0)), "gram")  # grams of one term
    ranked = grams.join(counts, ["kind", "gram"], "left").withColumn("place", F.row_number().over(order))
    alone = F.floor(c("n") * F.lit(round(LEAST_WORD_SIMILARITY * 100)) / 100)
    looked_up = ranked.where(F.when(c("kind") == "has", c("place") == 1).otherwise(c("place") <= c("n") - alone))
    return index.join(few(looked_up.select("request_id", "kind", "gram")), ["kind", "gram"]).select("request_id", "id").distinct()


def by_terms(asked: DataFrame, events: DataFrame, venues: DataFrame) -> DataFrame:
    """`by_text` without a stored index. Up to FEW_TERMS terms are looked for in every text as they are, in one pass;
    more of them by postings made on the way."""
    terms = [r["q"] for r in asked.where("q is not null").select(F.lower("q").alias("q")).distinct().limit(FEW_TERMS + 1).collect()]
    if len(terms) > FEW_TERMS:
        return by_text(asked, text_index(events, venues))
    sought = F.array(*map(F.lit, terms)).cast("array<string>")
    held = whole_text(events, venues).select("id", F.explode(let(F.lower("whole"), lambda low: F.filter(sought, lambda t: F.contains(low, t)))).alias("low"))
    held = held.join(asked.select("request_id", F.lower("q").alias("low")), "low").select("request_id", "id")
    return held.unionByName(by_text(asked, text_index(events, venues, ("run", "place")))).distinct()


#: What requests are looked up by: those that have these alike share one list of events, or one for each place.
FILTERS = ["status", "category", "free", "q", "from", "to"]


def first_events(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first rows of each key by instant and id, as many as its column `most` says, `most` at most. That is a literal,
    by which Spark cuts lists in the tasks before it exchanges them."""
    order = Window.partitionBy(*keys).orderBy("sort_instant", "id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).where(F.col("_n") <= F.col("most")).drop("_n")


def discover_batch(events: DataFrame, occurrences: DataFrame, venues: DataFrame, requests: DataFrame, suppressed: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(request_id, rank, id, sort_instant, distance_meters) of many good requests (request_id, params) in one job.

    Requests of equal filters (all but place, radius and limit) are one group. A group meets events by equality on its
    most selective part: weeks, else grams of a text, else its status; equal ranges of dates and equal terms are met once.
    All its conditions are checked, and its events are cut to the most that a request of it may show: once for the group
    and, where it has requests with a place, at each place, as events of one place are as far. A request then takes its
    group's list, or those of the places in its radius, so it isn't multiplied by events.
    index: a stored `text_index` of events and venues; without one its postings are made on the way.
    """
    c = F.col
    asked = requests.select("request_id", "params.*").withColumnRenamed("start", "from").withColumnRenamed("end", "to").withColumn("q", F.nullif("q", F.lit("")))
    asked = asked.withColumn("group", F.sha2(F.to_json(F.struct(*FILTERS)), 256))
    groups = asked.groupBy("group", *FILTERS).agg(F.max("limit").alias("most"), F.max(c("lat").isNotNull()).alias("placed"), F.max(c("lat").isNull()).alias("anywhere"))
    most = asked.agg(F.max("limit")).first()[0] or 0
    occ = occurrences if "ends_at" in occurrences.columns else occurrences.withColumn("ends_at", F.lit(None).cast("timestamp"))
    occ = occ.select(
        c("event_id").alias("id"), effective_instant(c("temporal_kind"), c("starts_at"), c("start_date")).alias("instant"),
        local_start(c("temporal_kind"), c("starts_at"), c("start_date")).alias("first"), local_end(c("temporal_kind"), c("starts_at"), c("ends_at"), c("start_date"), c("end_date")).alias("last"),
    )
    own = events.select("id", "category_id", "status", "free", "title", "description", "venue_id")
    if suppressed is not None:
        own = own.join(suppressed.select("id"), "id", "left_anti")
    places = venues.select(c("id").alias("venue_id"), c("name").alias("venue_name"), "latitude", "longitude")
    short = own.select("id", c("category_id").alias("own_category"), c("status").alias("own_status"), c("free").alias("own_free"), c("venue_id").alias("place_id"))
    fits = (c("category").isNull() | (c("category") == c("own_category"))) & (c("free").isNull() | c("own_free").eqNullSafe(c("free")))
    # equal terms, and the events that they fit
    terms = groups.where("q is not null").select(c("q").alias("request_id"), "q").distinct()
    texts = by_terms(terms, own, venues) if index is None else by_text(terms, index)
    texts = texts.withColumnRenamed("request_id", "q").join(own.join(places, "venue_id", "left"), "id").where(text_match(c("q"), c("title"), c("description"), c("venue_name"))).select("q", "id")
    # the events of each group: of its dates, or of its text, or of its status
    dated = by_dates(groups, occ.join(own.select("id", "status"), "id")).join(short.drop("own_status"), "id")
    by_range = dated.join(groups, ["status", "from", "to"]).where(fits)
    timed = short.join(occ.groupBy("id").agg(F.min("instant").alias("sort_instant")), "id")
    undated = groups.where("`from` is null")
    by_term = timed.join(texts, "id").join(undated.where("q is not null"), "q").where(fits & (c("status") == c("own_status")))
    # these groups are no more than there are statuses, categories and prices
    plain = timed.join(F.broadcast(undated.where("q is null")), c("status") == c("own_status")).where(fits)
    shape = ["group", "q", "id", "sort_instant", "place_id", "most", "placed", "anywhere"]
    found_in = by_range.where("q is null").select(*shape).unionByName(by_range.where("q is not null").join(texts, ["q", "id"]).select(*shape)).unionByName(by_term.select(*shape)).unionByName(plain.select(*shape))
    anywhere = first_events(found_in.where("anywhere"), ["group"], most).select("group", "id", "sort_instant")
    at_place = first_events(found_in.where("placed and place_id is not null"), ["group", "place_id"], most).select("group", "place_id", "id", "sort_instant")
    free_rows = asked.where("lat is null").join(anywhere, "group").select("request_id", "limit", "id", "sort_instant", F.lit(None).cast("double").alias("distance_meters"))
    near = by_cells(asked, places.select(c("venue_id").alias("place_id"), "latitude", "longitude"))
    near_rows = near.join(asked.select("request_id", "group", "limit"), "request_id").join(at_place, ["group", "place_id"]).select("request_id", "limit", "id", "sort_instant", "distance_meters")
    order = Window.partitionBy("request_id").orderBy(F.asc_nulls_first("distance_meters"), "sort_instant", "id")
    return free_rows.unionByName(near_rows).withColumn("rank", F.row_number().over(order)).where(c("rank") <= c("limit")).select("request_id", "rank", "id", "sort_instant", "distance_meters")


__all__ = ["PERIODS", "Request", "discover", "discover_batch", "found", "full_scan", "matching", "page", "public_page", "validated"]
