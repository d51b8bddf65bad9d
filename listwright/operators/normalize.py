"""Feed rows to canonical events, or the first reason why not. No row is dropped: `split` makes the two tables.

A canonical row: id, source_id, external_id, slug, title, description, category_id, subcategories, status, occurrence,
venue, performers, price, image_url, ticket_url, source_url, confidence, quality_score, ranking_score, seen_at, reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.temporal import FEED_OFFSET, ZONE, is_calendar_date
from listwright.functions.text import blank_to_null, event_slug, external_id_of, is_http_url, slug
from listwright.sources.feeds import AGENDA, AGENDA_EVENT_URL, CURATED, TICKET, TICKET_EVENT_URL

# Confidence by feed, the provisional scores, the status codes of the ticket feed, and the scope of the others.
CONFIDENCE = {"ticket": 0.9, "agenda": 0.75, "curated": 0.95}
PROVISIONAL_SCORE = 0.5
STATUS_CODES = {"onsale": "scheduled", "offsale": "scheduled", "cancelled": "cancelled", "canceled": "cancelled", "postponed": "postponed", "rescheduled": "rescheduled"}
CITY, STATE, COUNTRY, CURRENCY = "Porto Alegre", "RS", "BR", "BRL"
STATUSES = ["scheduled", "cancelled", "postponed", "rescheduled", "completed"]

VENUE = "struct<id: string, name: string, address: string, neighborhood: string, city: string, state: string, country: string, latitude: double, longitude: double>"
PRICE = "struct<free: boolean, min: double, max: double, currency: string>"
OCCURRENCE = "struct<id: string, temporal_kind: string, starts_at: timestamp, ends_at: timestamp, start_date: date, end_date: date, timezone: string, status: string>"


def map_status(code: Column) -> Column:
    pairs = [x for k, v in STATUS_CODES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), code)


def venue_of(id_: Column, name: Column, address: Column, neighborhood: Column, city: Column, state: Column, lat: Column, lng: Column) -> Column:
    parts = {"id": F.coalesce(blank_to_null(id_), F.concat(F.lit("venue-"), slug(name))), "name": name, "address": address, "neighborhood": neighborhood, "city": city, "state": state, "country": F.lit(COUNTRY), "latitude": lat, "longitude": lng}
    return F.struct(*(c.alias(k) for k, c in parts.items())).cast(VENUE)


def good_coordinates(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(-90, 90), F.lit(True)) & F.coalesce(lng.between(-180, 180), F.lit(True))


def flag_price(free: Column, value: Column) -> Column:
    """Free wins over a value; neither is unknown, which is null."""
    paid = F.struct(F.lit(False).alias("free"), value.alias("min"), value.alias("max"), F.lit(CURRENCY).alias("currency")).cast(PRICE)
    none = F.lit(None).cast("double")
    gratis = F.struct(F.lit(True).alias("free"), none.alias("min"), none.alias("max"), F.lit(CURRENCY).alias("currency")).cast(PRICE)
    return F.when(free.eqNullSafe(F.lit(True)), gratis).when(value.isNotNull(), paid)


def range_price(ranges: Column) -> Column:
    """From the first range: other currencies are unknown, 0 to 0 is free."""
    first = F.try_element_at(ranges, F.lit(1))
    nothing = (F.coalesce(first["min"], F.lit(-1.0)) == 0) & (F.coalesce(first["max"], F.lit(-1.0)) == 0)
    paid = F.struct(F.lit(False).alias("free"), first["min"].alias("min"), first["max"].alias("max"), F.lit(CURRENCY).alias("currency")).cast(PRICE)
    return F.when(first.isNull() | (first["currency"] != CURRENCY), F.lit(None).cast(PRICE)).when(nothing, flag_price(F.lit(True), F.lit(None).cast("double"))).otherwise(paid)


def clock_instant(date: Column, clock: Column) -> Column:
    return F.try_to_timestamp(F.concat(date, F.lit("T"), clock, F.lit(f":00{FEED_OFFSET}")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def feed_occurrence(id_: Column, start: Column, end: Column, start_time: Column, end_time: Column) -> Column:
    """Timed for one day with a readable time, else a date or a range of dates; an end before the start is no end."""
    begins, ends = clock_instant(start, start_time), clock_instant(start, end_time)
    timed = (F.nullif(end, F.lit("")).isNull() | (end == start)) & begins.isNotNull()
    return F.struct(
        id_.alias("id"),
        F.when(timed, "timed").otherwise("date").alias("temporal_kind"),
        F.when(timed, begins).alias("starts_at"),
        F.when(timed & (ends >= begins), ends).alias("ends_at"),
        F.when(~timed, F.try_to_date(start, "yyyy-MM-dd")).alias("start_date"),
        F.when(~timed, F.try_to_date(F.nullif(end, F.lit("")), "yyyy-MM-dd")).alias("end_date"),
        F.lit(ZONE).alias("timezone"),
        F.lit("scheduled").alias("status"),
    ).cast(OCCURRENCE)


def feed_dates_error(start: Column, end: Column, start_time: Column) -> Column:
    """What the domain checks find in a date-only occurrence."""
    own_end = F.nullif(end, F.lit(""))
    timed = (own_end.isNull() | (end == start)) & clock_instant(start, start_time).isNotNull()
    return F.when(~timed, F.when(~is_calendar_date(start), "startDate is not a calendar date").when(own_end.isNotNull() & ~is_calendar_date(own_end), "endDate is not a calendar date").when(own_end < start, "endDate is before startDate"))


def canonical(feed: DataFrame, source_id: str, external_id: Column, now: Column, **cols: Column) -> DataFrame:
    event_id = F.concat_ws("-", F.lit(source_id), external_id)
    title = blank_to_null(cols["title"])
    return feed.select(
        F.when(external_id.isNotNull(), event_id).alias("id"),
        F.lit(source_id).alias("source_id"),
        external_id.alias("external_id"),
        event_slug(title, F.lit(source_id), external_id).alias("slug"),
        title.alias("title"),
        *(cols[k].alias(k) for k in ("description", "category_id", "subcategories", "status", "occurrence", "venue", "performers", "price", "image_url", "ticket_url", "source_url")),
        cols["confidence"].alias("confidence"),
        F.lit(PROVISIONAL_SCORE).alias("quality_score"),
        F.lit(PROVISIONAL_SCORE).alias("ranking_score"),
        now.cast("timestamp").alias("seen_at"),
        cols["reason"].alias("reason"),
    )


def normalize_ticket(feed: DataFrame, now: Column, source_id: str = TICKET) -> DataFrame:
    own = blank_to_null(F.col("id"))
    code = F.col("dates.status.code")
    status, starts = map_status(code), F.try_to_timestamp(F.col("dates.start.dateTime"))
    classes = F.col("classifications")
    chosen = F.coalesce(F.try_element_at(F.filter(classes, lambda c: c["primary"]), F.lit(1)), F.try_element_at(classes, F.lit(1)))
    segment, genre = F.nullif(chosen["segment"]["name"], F.lit("")), F.nullif(chosen["genre"]["name"], F.lit(""))
    v = F.try_element_at(F.col("_embedded.venues"), F.lit(1))
    lat, lng = v["location"]["latitude"].try_cast("double"), v["location"]["longitude"].try_cast("double")
    filled = [F.nullif(x, F.lit("")).isNotNull() for x in (v["name"], v["city"]["name"], v["state"]["stateCode"])]
    venue = F.when(filled[0] & filled[1] & filled[2] & (v["country"]["countryCode"] == COUNTRY) & good_coordinates(lat, lng), venue_of(v["id"], v["name"], v["address"]["line1"], F.lit(None).cast("string"), v["city"]["name"], v["state"]["stateCode"], lat, lng))
    acts = F.filter(F.col("_embedded.attractions"), lambda a: F.nullif(a["name"], F.lit("")).isNotNull())
    performers = F.coalesce(F.transform(acts, lambda a: F.struct(F.coalesce(F.nullif(a["id"], F.lit("")), F.concat(F.lit("performer-"), slug(a["name"]))).alias("id"), a["name"].alias("name"))), F.expr("cast(array() as array<struct<id: string, name: string>>)"))
    url = F.coalesce(F.col("url"), F.concat(F.lit(TICKET_EVENT_URL), own))
    occurrence = F.struct(
        F.concat_ws("-", F.lit(source_id), own, F.lit("occ-1")).alias("id"), F.lit("timed").alias("temporal_kind"), starts.alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"),
        F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(ZONE).alias("timezone"), status.alias("status"),
    ).cast(OCCURRENCE)
    reason = (
        F.when(own.isNull(), "missing id").when(blank_to_null(F.col("name")).isNull(), "missing name")
        .when(status.isNull(), F.concat(F.lit("unmappable status: "), F.coalesce(code, F.lit("(none)")))).when(starts.isNull(), "no precise start")
    )
    return canonical(
        feed, source_id, own, now, title=F.col("name"), description=blank_to_null(F.col("info")), category_id=slug(segment), subcategories=F.when(genre.isNull(), F.array().cast("array<string>")).otherwise(F.array(slug(genre))),
        status=status, occurrence=occurrence, venue=venue, performers=performers, price=range_price(F.col("priceRanges")), image_url=F.try_element_at(F.col("images.url"), F.lit(1)), ticket_url=url, source_url=url, confidence=F.lit(CONFIDENCE["ticket"]), reason=reason,
    )


def feed_categories() -> tuple[Column, Column]:
    slugs = F.filter(F.transform(F.coalesce(F.col("categories"), F.array().cast("array<string>")), slug), lambda c: c != "")
    return F.try_element_at(slugs, F.lit(1)), F.when(F.size(slugs) > 1, F.slice(slugs, F.lit(2), F.greatest(F.size(slugs) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))


NO_PERFORMERS = "cast(array() as array<struct<id: string, name: string>>)"


def normalize_agenda(feed: DataFrame, now: Column, source_id: str = AGENDA) -> DataFrame:
    own = external_id_of(F.col("id"), F.col("url"))
    start, end = F.nullif(F.col("startDate"), F.lit("")), F.col("endDate")
    category, rest = feed_categories()
    name = blank_to_null(F.col("venueName"))
    none = F.lit(None).cast("double")
    venue = F.when(name.isNotNull(), venue_of(F.lit(None).cast("string"), name, F.nullif(F.col("address"), F.lit("")), F.nullif(F.col("neighborhood"), F.lit("")), F.lit(CITY), F.lit(STATE), none, none))
    reason = F.when(own.isNull(), "missing id").when(blank_to_null(F.col("title")).isNull(), "missing name").when(start.isNull(), "missing date").otherwise(feed_dates_error(start, end, F.col("startTime")))
    return canonical(
        feed, source_id, own, now, title=F.col("title"), description=blank_to_null(F.col("description")), category_id=category, subcategories=rest, status=F.lit("scheduled"),
        occurrence=feed_occurrence(F.concat_ws("-", F.lit(source_id), own, F.lit("occ-1")), start, end, F.col("startTime"), F.col("endTime")), venue=venue, performers=F.expr(NO_PERFORMERS), price=flag_price(F.col("free"), F.col("priceValue")),
        image_url=F.nullif(F.col("imageUrl"), F.lit("")), ticket_url=F.nullif(F.col("externalUrl"), F.lit("")), source_url=F.coalesce(F.col("url"), F.concat(F.lit(AGENDA_EVENT_URL), own, F.lit("/"))), confidence=F.lit(CONFIDENCE["agenda"]), reason=reason,
    )


def normalize_curated(feed: DataFrame, now: Column, source_id: str = CURATED) -> DataFrame:
    own = blank_to_null(F.col("id"))
    start, end = F.nullif(F.col("startDate"), F.lit("")), F.col("endDate")
    name, page = blank_to_null(F.col("venueName")), blank_to_null(F.col("sourceUrl"))
    ticket, image = F.nullif(F.col("ticketUrl"), F.lit("")), F.nullif(F.col("imageUrl"), F.lit(""))
    price, lat, lng = F.col("priceValue"), F.col("latitude"), F.col("longitude")
    category, rest = feed_categories()
    bad_price = price.isNotNull() & (F.isnan(price) | (F.abs(price) == float("inf")) | (price < 0))
    reason = (
        F.when(own.isNull(), "missing id").when(blank_to_null(F.col("title")).isNull(), "missing title").when(start.isNull(), "missing startDate").when(name.isNull(), "missing venue")
        .when(page.isNull() | ~is_http_url(page), "invalid sourceUrl").when(ticket.isNotNull() & ~is_http_url(ticket), "invalid ticketUrl").when(image.isNotNull() & ~is_http_url(image), "invalid imageUrl")
        .when(bad_price, "invalid priceValue").when(lat.isNotNull() != lng.isNotNull(), "one coordinate without the other").when(~good_coordinates(lat, lng), "coordinates out of range").otherwise(feed_dates_error(start, end, F.col("startTime")))
    )
    return canonical(
        feed, source_id, own, now, title=F.col("title"), description=blank_to_null(F.col("description")), category_id=category, subcategories=rest, status=F.lit("scheduled"),
        occurrence=feed_occurrence(F.concat_ws("-", F.lit(source_id), own, F.lit("occ-1")), start, end, F.col("startTime"), F.col("endTime")),
        venue=venue_of(F.lit(None).cast("string"), name, F.nullif(F.col("address"), F.lit("")), F.nullif(F.col("neighborhood"), F.lit("")), F.lit(CITY), F.lit(STATE), lat, lng), performers=F.expr(NO_PERFORMERS), price=flag_price(F.col("free"), price),
        image_url=F.when(F.col("imageRightsConfirmed").eqNullSafe(F.lit(True)), image), ticket_url=ticket, source_url=page, confidence=F.lit(CONFIDENCE["curated"]), reason=reason,
    )


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their reason)."""
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, violations array) of the rows that break a rule; a rule is true where it's broken."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules.items())))
    return rows.select(F.col(key), found.alias("violations")).where(F.size("violations") > 0)


def event_rules() -> dict[str, Column]:
    return {
        "blank_title": blank_to_null(F.col("title")).isNull(), "blank_slug": blank_to_null(F.col("slug")).isNull(),
        "no_occurrence": F.coalesce(F.size("occurrences"), F.lit(0)) < 1, "no_source": F.coalesce(F.size("sources"), F.lit(0)) < 1,
        "quality_out_of_range": ~F.col("quality_score").between(0, 1), "seen_order": F.col("first_seen_at") > F.col("last_seen_at"), "update_order": F.col("created_at") > F.col("updated_at"),
    }


def occurrence_rules() -> dict[str, Column]:
    timed = F.col("temporal_kind") == "timed"
    return {
        "unknown_kind": ~F.col("temporal_kind").isin("timed", "date"),
        "kind_shape": F.when(timed, F.col("starts_at").isNull() | F.col("start_date").isNotNull() | F.col("end_date").isNotNull()).otherwise(F.col("start_date").isNull() | F.col("starts_at").isNotNull() | F.col("ends_at").isNotNull()),
        "instant_order": F.col("ends_at") < F.col("starts_at"), "date_order": F.col("end_date") < F.col("start_date"),
    }


def venue_rules() -> dict[str, Column]:
    return {"latitude_out_of_range": ~F.col("latitude").between(-90, 90), "longitude_out_of_range": ~F.col("longitude").between(-180, 180)}


def reference_rules() -> dict[str, Column]:
    return {"confidence_out_of_range": ~F.col("confidence").between(0, 1)}


def source_rules() -> dict[str, Column]:
    return {"authority_out_of_range": ~F.col("authority_score").between(0, 1), "polling_not_positive": F.col("polling_interval_minutes") <= 0}
