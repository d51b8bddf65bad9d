"""State tables as snapshots: each function joins the old snapshot with a batch and returns the new one.

Plain Parquet has no MERGE: write a result to a new folder and switch to it; never overwrite what is being read. Every
upsert run twice with the same batch gives what running it once gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions.temporal import utc_day


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first by `order`. A key with very many versions is pre-aggregated in the tasks."""
    others = [c for c in rows.columns if c not in keys]
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").select(*keys, *others)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Full outer join on the keys: new rows overwrite all columns, nulls included, but those of `keep`, where the old
    value survives if there is one."""
    kept = set(keep or [])
    joined = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    isnew = F.col("n._new").isNotNull()

    def column(c: str) -> Column:
        if c in keys or c in kept:
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        return F.when(isnew, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*map(column, old.columns))


def upsert_raw(old: DataFrame, batch: DataFrame) -> DataFrame:
    """By (source_id, external_id): the row keeps its id, gets the batch's newest content, is pending again without an
    error. Rows without an external id are always added."""
    fresh = batch.withColumns({"processing_status": F.lit("pending"), "processing_error": F.lit(None).cast("string")})
    for c in old.columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
    keyed = latest(fresh.where("external_id is not null"), ["source_id", "external_id"], F.desc("fetched_at"), F.desc("id")).select(*old.columns)
    merged = upsert(old.where("external_id is not null"), keyed, ["source_id", "external_id"], keep=["id"])
    return merged.unionByName(old.where("external_id is null")).unionByName(fresh.where("external_id is null").select(*old.columns))


def mark_processed(raw: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes: (source_id, external_id, status, error). Rows without an external id stay as they are."""
    own = outcomes.where("external_id is not null").select("source_id", "external_id", F.col("status").alias("_status"), F.col("error").alias("_error"))
    joined = raw.join(own, ["source_id", "external_id"], "left")
    hit = F.col("_status").isNotNull()
    return joined.withColumns({"processing_status": F.coalesce("_status", "processing_status"), "processing_error": F.when(hit, F.col("_error")).otherwise(F.col("processing_error"))}).select(*raw.columns)


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is in a set of keys."""
    return rows.join(keys.select(*on), on, "left_semi")


def upsert_events(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["id"], keep=["first_seen_at", "created_at"])


def replace_children(old: DataFrame, new: DataFrame, touched: DataFrame, parent: str = "event_id") -> DataFrame:
    """Children of the touched parents are replaced; touched has a column id."""
    gone = touched.select(F.col("id").alias(parent)).distinct()
    return old.join(gone, parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def reconcile_refs(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Source references: a touched event keeps only those of the new save, with their old first_seen_at."""
    seen = old.select("event_id", "source_id", F.col("first_seen_at").alias("_first"))
    own = new.join(seen, ["event_id", "source_id"], "left").withColumn("first_seen_at", F.coalesce("_first", "first_seen_at"))
    return replace_children(old, own, touched)


def upsert_venues(old: DataFrame, new: DataFrame, seen: str = "seen_at") -> DataFrame:
    """The last write of each id wins; nothing is deleted."""
    others = [c for c in old.columns if c != "id"]
    last = new.groupBy("id").agg(F.max_by(F.struct(*others), seen).alias("v")).select("id", "v.*")
    return upsert(old, last, ["id"])


def upsert_sources(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    own = [c for c in old.columns if c not in ("created_at", "updated_at")]
    stamped = new.select(*own, now.alias("created_at"), now.alias("updated_at"))
    return upsert(old, stamped, ["id"], keep=["created_at"])


#: Days that an occurrence of a clustered table may last without being among the lasting ones.
SHORT_DAYS = 7


def write_occurrences(occurrences: DataFrame, path: str) -> None:
    """Occurrences in folders by lasting (more than SHORT_DAYS) and by the week of their first day in UTC, sorted within
    their files, with the columns utc_first and utc_last that `discover.matching` filters by. A week of very many
    occurrences is in several files."""
    c = F.col
    own = occurrences if "ends_at" in occurrences.columns else occurrences.withColumn("ends_at", F.lit(None).cast("timestamp"))
    timed = c("temporal_kind") == "timed"
    first = F.when(timed, utc_day(c("starts_at"))).otherwise(c("start_date"))
    last = F.when(timed, utc_day(F.coalesce("ends_at", "starts_at"))).otherwise(F.coalesce("end_date", "start_date"))
    rows = own.withColumns({"utc_first": first, "utc_last": F.greatest(first, last)})
    rows = rows.withColumns({"lasting": F.datediff("utc_last", "utc_first") > SHORT_DAYS, "utc_week": F.floor(F.unix_date("utc_first") / 7).cast("int")})
    rows.repartitionByRange("lasting", "utc_week", "utc_first", "event_id").sortWithinPartitions("lasting", "utc_week", "utc_first").write.partitionBy("lasting", "utc_week").parquet(path)


def in_clustered_range(start: Column, end: Column) -> Column:
    """A condition on columns of `write_occurrences` that every occurrence passes whose local dates meet the range: local
    and UTC dates are a day apart at most. It reaches the scan."""
    c = F.col
    week = lambda day: F.floor(F.unix_date(day) / 7)
    near = (c("utc_first") <= F.date_add(end, 1)) & (c("utc_last") >= F.date_add(start, -1))
    return near & (c("utc_week") <= week(F.date_add(end, 1))) & (c("lasting") | (c("utc_week") >= week(F.date_add(start, -1 - SHORT_DAYS))))


def nested_children(rows: DataFrame, name: str, order: list[str], parent: str = "event_id") -> DataFrame:
    """(parent, array of structs in order)."""
    others = [c for c in rows.columns if c not in (parent, *order)]
    return rows.groupBy(parent).agg(F.sort_array(F.collect_list(F.struct(*order, *others))).alias(name))


def hydrate(events: DataFrame, occurrences: DataFrame, venues: DataFrame, refs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Events with nested occurrences, sources and venue. With ids (id, pos), only those, missing ones skipped, and the
    column pos to order by."""
    own = events if ids is None else events.join(ids, "id")
    key = own.select(F.col("id").alias("event_id"))
    occ = nested_children(occurrences.join(key, "event_id", "left_semi"), "occurrences", ["sort_instant", "id"]) if "sort_instant" in occurrences.columns else nested_children(occurrences.join(key, "event_id", "left_semi"), "occurrences", ["id"])
    src = nested_children(refs.join(key, "event_id", "left_semi"), "sources", ["source_id"])
    venue = venues.select(F.col("id").alias("venue_id"), F.struct(*venues.columns).alias("venue"))
    rows = own.join(occ.withColumnRenamed("event_id", "id"), "id", "left").join(src.withColumnRenamed("event_id", "id"), "id", "left").join(venue, "venue_id", "left")
    return rows if ids is None else rows.orderBy("pos")


def positions(ids: DataFrame, column: str = "ids") -> DataFrame:
    """(id, pos) of an array column of ids."""
    return ids.select(F.posexplode(column).alias("pos", "id")).select("id", "pos")


def categories(events: DataFrame) -> DataFrame:
    return events.where("category_id is not null").select("category_id").distinct().orderBy("category_id")


def duplicates(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """(violation, key, rows) of keys that occur more than once; null keys don't count."""
    there = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    return there.groupBy(F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key")).agg(F.count("*").alias("rows")).where("rows > 1").select(F.lit(code).alias("violation"), "key", "rows")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str, code: str) -> DataFrame:
    """(violation, key, rows) of children without a parent."""
    own = parent.select(F.col(pk).alias(fk))
    return child.where(F.col(fk).isNotNull()).join(own, fk, "left_anti").groupBy(F.col(fk).cast("string").alias("key")).agg(F.count("*").alias("rows")).select(F.lit(code).alias("violation"), "key", "rows")


def ingestion_summary(rows: DataFrame) -> DataFrame:
    """Counts of one run's normalized rows (reason null or not), by source."""
    good = F.col("reason").isNull()
    return rows.groupBy("source_id").agg(F.count("*").alias("discovered"), F.count("*").alias("raw_saved"), F.count_if(good).alias("normalized"), F.count_if(good).alias("canonical_saved"), F.count_if(~good).alias("failed"))


def without_prefix(events: DataFrame, occurrences: DataFrame, refs: DataFrame, candidates: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events whose id begins with `prefix` go, with their children and candidate pairs; raw rows aren't touched."""
    gone = events.where(F.startswith("id", F.lit(prefix))).select("id")

    def rest(rows: DataFrame, key: str) -> DataFrame:
        return rows.join(gone.withColumnRenamed("id", key), key, "left_anti").select(*rows.columns)

    return rest(events, "id"), rest(occurrences, "event_id"), rest(refs, "event_id"), rest(rest(candidates, "left_id"), "right_id")


def pending(raw: DataFrame, schema: str) -> DataFrame:
    """Stored payloads that wait to be normalized again, as feed rows beside their raw keys."""
    return raw.where("processing_status = 'pending'").select("source_id", F.col("external_id").alias("raw_external_id"), F.from_json("payload", schema).alias("e")).select("source_id", "raw_external_id", "e.*")


def together(*parts: DataFrame) -> DataFrame:
    """Canonical rows of several sources side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
