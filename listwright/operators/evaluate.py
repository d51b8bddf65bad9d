"""Evaluation of the matcher on labelled pairs: validation, summaries, partitions, metrics, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closed vocabularies and the least number of cases.
TRUTHS, ROUTINGS, LEVELS = ["same", "different", "uncertain"], ["auto_merge", "review", "separate"], ["easy", "medium", "hard"]
CONFLICTS = ["venue_conflict", "date_conflict", "time_conflict", "performer_conflict", "city_conflict", "event_scope_conflict", "edition_conflict"]
KINDS = ["timed", "date", "date-range"]
LEAST_CASES = 40
# The ten cases held out.
HOLDOUT = ["GD-P02", "GD-P08", "GD-P13", "GD-N04", "GD-N07", "GD-N09", "GD-N10", "GD-A03", "GD-A06", "GD-A09"]


def side_kind(o: Column) -> Column:
    return F.when(o["kind"] == "timed", "timed").when(o["endDate"].isNotNull(), "date-range").otherwise("date")


def temporal_pairing(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "-vs-")


def dataset_errors(cases: DataFrame, conflicts: list[str] | None = None) -> DataFrame:
    """(code, key) violations of a labelled set; empty if it's valid."""
    words = F.array(*map(F.lit, conflicts or CONFLICTS))
    c = F.col
    rules = {
        "unknown_truth": ~c("identityTruth").isin(TRUTHS), "unknown_routing": ~c("expectedRouting").isin(ROUTINGS), "unknown_difficulty": ~c("difficulty").isin(LEVELS),
        "unknown_conflict": F.size(F.array_except(F.coalesce("criticalConflicts", F.array().cast("array<string>")), words)) > 0,
        "empty_rationale": F.coalesce(F.trim("rationale"), F.lit("")) == "", "empty_tags": F.coalesce(F.size("tags"), F.lit(0)) < 1,
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(x, F.lit(True)), F.lit(k)) for k, x in rules.items())))
    by_case = cases.select(F.explode(found).alias("code"), c("id").alias("key"))
    again = cases.groupBy("id").count().where("count > 1").select(F.lit("repeated_case").alias("code"), c("id").alias("key"))
    sides = cases.select(F.explode(F.array("left.id", "right.id")).alias("key"))
    events = sides.groupBy("key").count().where("count > 1").select(F.lit("repeated_event").alias("code"), "key")
    few = cases.agg(F.count("*").alias("n")).where(c("n") < LEAST_CASES).select(F.lit("too_few_cases").alias("code"), c("n").cast("string").alias("key"))

    def missing(code: str, expected: list[str], values: Column) -> DataFrame:
        there = cases.select(F.explode(values).alias("v")).agg(F.coalesce(F.collect_set(F.when(F.col("v").isin(expected), F.col("v"))), F.array().cast("array<string>")).alias("s"))
        return there.select(F.explode(F.array_except(F.array(*map(F.lit, expected)), "s")).alias("key")).select(F.lit(code).alias("code"), "key")

    out = by_case
    for part in (again, events, few, missing("truth_not_covered", TRUTHS, F.array("identityTruth")), missing("routing_not_covered", ROUTINGS, F.array("expectedRouting")), missing("kind_not_covered", KINDS, F.array(side_kind(c("left.occurrence")), side_kind(c("right.occurrence"))))):
        out = out.unionByName(part)
    return out


def dataset_summary(cases: DataFrame) -> DataFrame:
    """(dimension, value, n) over scalar and array columns of the cases that there are."""
    scalars = [c for c in ("truth", "expected_routing", "difficulty", "pairing", "identityTruth", "expectedRouting") if c in cases.columns]
    arrays = [c for c in ("criticalConflicts", "tags") if c in cases.columns]

    def cells_of(name: str) -> Column:
        return F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value")))

    one = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in scalars))
    cells = F.flatten(F.array(one, *map(cells_of, arrays)))
    return cases.select(F.explode(cells).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def partition(cases: DataFrame, name: str, holdout: DataFrame | None = None) -> DataFrame:
    """`name` is calibration, holdout or all; holdout (case_id) is the fixed list unless given."""
    if name == "all":
        return cases
    if holdout is None:
        held = F.col("case_id").isin(HOLDOUT)
        return cases.where(held if name == "holdout" else ~held)
    return cases.join(holdout.select("case_id"), "case_id", {"holdout": "left_semi", "calibration": "left_anti"}[name])


def confusion(results: DataFrame) -> DataFrame:
    return results.groupBy("expected_routing").pivot("routing", ROUTINGS).agg(F.count(F.lit(1))).na.fill(0, ROUTINGS)


def metrics(results: DataFrame) -> DataFrame:
    """One row. Ratios without a denominator are null, but for accuracy and review rate, which are 0."""
    c, n = F.col, F.count_if
    merged, apart = c("routing") == "auto_merge", c("routing") == "separate"
    same, different, unsure = (c("truth") == t for t in TRUTHS)
    ratio = lambda a, b: F.try_divide(n(a), n(b))
    zero = lambda a: F.coalesce(F.try_divide(n(a), F.count("*")), F.lit(0.0))
    return results.agg(
        F.count("*").alias("cases"), zero(c("routing") == c("expected_routing")).alias("routing_accuracy"), ratio(merged & same, merged).alias("auto_merge_precision"), ratio(merged & same, same).alias("auto_merge_recall"),
        ratio(apart & different, apart).alias("separate_precision"), zero(c("routing") == "review").alias("review_rate"), n(merged & different).alias("false_merges_different"), n(merged & unsure).alias("false_merges_uncertain"),
        n(merged & ~same).alias("false_merges"), n(apart & same).alias("false_separates"),
    )


def accuracy_by(results: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, value, cases, accuracy) for each dimension, by one pass over grouping sets."""
    correct = (F.col("routing") == F.col("expected_routing")).cast("double")
    cells = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions)))
    return results.select(cells.alias("x"), correct.alias("ok")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("cases"), F.avg("ok").alias("accuracy"))


def incorrect(results: DataFrame) -> DataFrame:
    return results.where(F.col("routing") != F.col("expected_routing"))


def gates(results: DataFrame, named_review: str | None = None) -> DataFrame:
    """One row of booleans, each true if the gate holds; results may have `eligible`."""
    merged = F.col("routing") == "auto_merge"
    eligible = F.col("eligible") if "eligible" in results.columns else F.lit(True)
    named = F.count_if((F.col("case_id") == named_review) & (F.col("routing") != "review")) == 0 if named_review else F.lit(True)
    return results.agg((F.count_if(merged & (F.col("truth") == "different")) == 0).alias("no_false_merge"), (F.count_if(merged & (F.col("truth") == "uncertain")) == 0).alias("no_uncertain_merge"), (F.count_if(merged & ~eligible) == 0).alias("no_ineligible_merge"), named.alias("named_case_in_review"))
