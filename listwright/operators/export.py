"""Export shapes: public rows, schema.org JSON-LD, sitemap, labels, display texts, map layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.functions.temporal import ZONE

# Labels by id, months, schema.org terms.
CATEGORY_LABELS = {
    "music": "Música", "show-de-musica": "Show de Música", "arts-theatre": "Teatro e Artes", "teatro-e-artes": "Teatro e Artes", "theater": "Teatro", "theatre": "Teatro", "cinema": "Cinema",
    "cultural": "Cultural", "literatura": "Literatura", "gastronomia": "Gastronomia", "miscellaneous": "Diversos", "exposicao": "Exposição", "passeio-cultural": "Passeio Cultural",
}
STATUS_LABELS = {"cancelled": "Cancelado", "postponed": "Adiado", "rescheduled": "Remarcado", "completed": "Encerrado"}
MONTHS = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]
STATUS_TYPES = {"scheduled": "EventScheduled", "cancelled": "EventCancelled", "postponed": "EventPostponed", "rescheduled": "EventRescheduled"}


def source_labels(brand: str) -> dict[str, str]:
    """Labels of the four sources; two of them carry the publisher's name."""
    return {"ticketmaster": "Ticketmaster", "destino-poa": "Destino POA", "manual-beta": f"Curadoria {brand}", "ui-demo": f"Conteúdo demonstrativo {brand}"}


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), key)


def category_label(c: Column) -> Column:
    return F.coalesce(lookup(CATEGORY_LABELS, c), c)


def source_label(c: Column, brand: str) -> Column:
    return F.coalesce(lookup(source_labels(brand), c), c)


def status_label(c: Column) -> Column:
    return lookup(STATUS_LABELS, c)


def instant_text(c: Column) -> Column:
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def occurrence_shape(o: Column) -> Column:
    """JSON text of one of two shapes; end keys are there even if null."""
    timed = F.to_json(F.struct(F.lit("timed").alias("kind"), instant_text(o["starts_at"]).alias("starts_at"), instant_text(o["ends_at"]).alias("ends_at"), F.lit(ZONE).alias("timezone"), o["status"].alias("status")), {"ignoreNullFields": "false"})
    dated = F.to_json(F.struct(F.lit("date").alias("kind"), o["start_date"].alias("start_date"), o["end_date"].alias("end_date"), F.lit(ZONE).alias("timezone"), o["status"].alias("status")), {"ignoreNullFields": "false"})
    return F.when(o["temporal_kind"] == "timed", timed).otherwise(dated)


def public_rows(events: DataFrame, *extra: str) -> DataFrame:
    """Hydrated events (venue, price, occurrences, sources) in the public shape; distance_meters only if there, and the
    columns `extra`."""
    c = F.col
    price = lambda k: c("price")[k]
    venue = F.when(c("venue").isNotNull(), F.struct(*(c("venue")[k].alias(k) for k in ("name", "address", "neighborhood", "city", "state", "country", "latitude", "longitude"))))
    sources = F.transform("sources", lambda s: F.struct(*(s[k].alias(k) for k in ("source_id", "external_id", "url", "confidence"))))
    return events.select(
        "id", "slug", "title", "description", "status", c("category_id").alias("category"), F.transform("occurrences", occurrence_shape).alias("occurrences"), venue.alias("venue"),
        price("free").alias("free"), price("min").alias("price_min"), price("max").alias("price_max"), price("currency").alias("currency"), "image_url", "ticket_url", sources.alias("sources"), "quality_score", "ranking_score",
        *(["distance_meters"] if "distance_meters" in events.columns else []), *extra,
    )


def json_ld(events: DataFrame, base_url: str) -> DataFrame:
    """(id, json) schema.org Event of hydrated events; absent parts are left out."""
    c = F.col
    first = F.try_element_at("occurrences", F.lit(1))
    timed = first["temporal_kind"] == "timed"
    text = lambda x: F.nullif(x, F.lit(""))
    address = F.struct(F.lit("PostalAddress").alias("@type"), text(c("venue.address")).alias("streetAddress"), c("venue.city").alias("addressLocality"), c("venue.state").alias("addressRegion"), c("venue.country").alias("addressCountry"))
    place = F.when(c("venue").isNotNull(), F.struct(F.lit("Place").alias("@type"), c("venue.name").alias("name"), address.alias("address")))
    offer = F.when(text(c("ticket_url")).isNotNull(), F.struct(F.lit("Offer").alias("@type"), c("ticket_url").alias("url"), c("price.currency").alias("priceCurrency"), F.when(c("price.free"), F.lit(0.0)).otherwise(c("price.min")).alias("price")))
    status = F.concat(F.lit("https://schema.org/"), lookup(STATUS_TYPES, c("status")))
    return events.select(
        "id",
        F.to_json(
            F.struct(
                F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), c("title").alias("name"), F.concat(F.lit(base_url.rstrip("/") + "/eventos/"), c("slug")).alias("url"), text(c("description")).alias("description"), text(c("image_url")).alias("image"),
                F.when(timed, instant_text(first["starts_at"])).otherwise(first["start_date"].cast("string")).alias("startDate"), F.when(timed, instant_text(first["ends_at"])).otherwise(first["end_date"].cast("string")).alias("endDate"),
                status.alias("eventStatus"), place.alias("location"), offer.alias("offers"),
            )
        ).alias("json"),
    )


def sitemap(visible: DataFrame, base_url: str) -> DataFrame:
    """(url, change_frequency, priority): the site itself and each visible event's page."""
    root = base_url.rstrip("/")
    home = visible.sparkSession.createDataFrame([(root, "hourly", 1.0)], "url string, change_frequency string, priority double")
    return home.unionByName(visible.select(F.concat(F.lit(f"{root}/eventos/"), F.col("slug")).alias("url"), F.lit("daily").alias("change_frequency"), F.lit(0.7).alias("priority")))


def money(value: Column, currency: Column) -> Column:
    """Brazilian notation: thousands by points, cents by a comma, a no-break space after the sign."""
    sign = F.when(F.coalesce(currency, F.lit("BRL")) == "BRL", "R$").otherwise(currency)
    return F.concat(sign, F.lit("\u00a0"), F.translate(F.format_number(value, 2), ",.", ".,"))


def price_text(free: Column, low: Column, high: Column, currency: Column) -> Column:
    """Unknown is null, never free."""
    span = low.isNotNull() & high.isNotNull() & (low != high)
    return F.when(free.eqNullSafe(F.lit(True)), "Grátis").when(span, F.concat(money(low, currency), F.lit(" – "), money(high, currency))).otherwise(money(F.coalesce(low, high), currency))


def month_name(d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), F.month(d))


def day_text(d: Column) -> Column:
    return F.concat_ws(" ", F.dayofmonth(d).cast("string"), month_name(d))


def occurrence_text(kind: Column, starts_at: Column, start_date: Column, end_date: Column) -> Column:
    local = F.from_utc_timestamp(starts_at.cast("timestamp"), ZONE)
    clock = F.concat(F.hour(local).cast("string"), F.lit("h"), F.when(F.minute(local) == 0, "").otherwise(F.lpad(F.minute(local).cast("string"), 2, "0")))
    one = end_date.isNull() | (end_date == start_date)
    same_month = F.month(start_date) == F.month(end_date)
    days = F.when(one, day_text(start_date)).when(same_month, F.concat(F.dayofmonth(start_date).cast("string"), F.lit("–"), day_text(end_date))).otherwise(F.concat(day_text(start_date), F.lit(" – "), day_text(end_date)))
    return F.when(kind == "timed", F.concat(day_text(local), F.lit(" · "), clock)).otherwise(days)


def distance_text(metres: Column) -> Column:
    return F.when(metres < 1000, F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m"))).otherwise(F.concat(F.translate(F.format_number(metres / 1000, 1), ",.", ".,"), F.lit(" km")))


def map_layer(rows: DataFrame) -> DataFrame:
    """Rows with both coordinates."""
    return rows.where("latitude is not null and longitude is not null")


def map_extent(rows: DataFrame) -> DataFrame:
    return map_layer(rows).agg(F.count("*").alias("n"), F.min("latitude").alias("south"), F.min("longitude").alias("west"), F.max("latitude").alias("north"), F.max("longitude").alias("east"))
