import re

import pytest
from pyspark.sql import functions as F

from listwright.functions import geo, temporal, text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("given", "expected"), [("Auditório  Araújo—Vianna!", "auditorio araujo vianna"), ("", ""), ("  ", ""), ("São João 2026", "sao joao 2026"), ("й Ά ΐ ё", "и α ι е"), ("Åå \u212b q\u0307", "aa a q")]
)
def test_normalize_text(spark, given, expected):
    assert value(spark, text.normalize_text(lit(given))) == expected
    assert value(spark, text.normalize_text(lit(given), full_unicode=True)) == expected


def test_significant_tokens(spark):
    assert value(spark, F.array_sort(text.significant_tokens(lit("Sarau de Poesia, sarau")))) == ["poesia", "sarau"]
    assert value(spark, text.significant_tokens(lit("de da"))) == []


def test_token_similarity(spark):
    assert value(spark, text.token_similarity(lit("Festival Cultura"), lit("Festival Cultura Popular do Sul"))) == 1.0
    assert value(spark, text.token_similarity(lit("de"), lit("de"))) == 0.0


def test_trigram_fixed_points(spark):
    assert value(spark, text.similarity(lit("joao"), lit("Show do João"))) == pytest.approx(0.125)
    assert value(spark, text.word_similarity(lit("joao"), lit("Show do João"))) == pytest.approx(0.4)
    assert value(spark, F.greatest(text.similarity(lit("Rock in Porto Alegre"), lit("Feira de Artesanato Local")), text.word_similarity(lit("Rock in Porto Alegre"), lit("Feira de Artesanato Local")))) <= 0.15
    assert value(spark, text.similarity(lit("Rock in Porto Alegre 2026"), lit("Rock in Porto Alegre"))) == pytest.approx(0.808, abs=1e-3)


def test_word_similarity_is_the_best_of_all_runs(spark):
    """Against all runs, on titles of all kinds and on whole texts, and what passes a bound."""
    import random

    def trigrams_of(t):
        return [w[i : i + 3] for w in (f"  {w} " for w in re.findall(r"[^\W_]+", t.lower())) for i in range(len(w) - 2)]

    def brute(a, b):
        wanted, best = set(a), 0.0
        for i in range(len(b)):
            run = set()
            for g in b[i:]:
                run.add(g)
                best = max(best, len(wanted & run) / len(wanted | run))
        return best

    draw = random.Random(4)
    vocabulary = "a ab abc abd bcd samba sambas show de do rock in rio são joão x1 12 123 aaa aaaa".split()
    some = lambda n: " ".join(draw.choices(vocabulary, k=draw.randrange(n)))
    pairs = [(some(6), some(14)) for _ in range(400)] + [(some(9), some(160)) for _ in range(4)] + [("joao", "Show do João"), ("banda sul", "a banda do sul e a banda"), ("x", ""), ("", "x"), ("aaa aaa", "aaa")]
    c = F.col
    rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    got = rows.select("a", "b", text.word_similarity(c("a"), c("b")).alias("value"), *(text.word_similar(c("a"), c("b"), t).alias(f"above{i}") for i, t in enumerate((0.15, 0.3, 0.6)))).collect()
    for r in got:
        if r["a"] is None or r["b"] is None:
            assert r["value"] is None and r["above0"] is None
            continue
        want = brute(trigrams_of(r["a"]), trigrams_of(r["b"]))
        assert r["value"] == pytest.approx(want), (r["a"], r["b"])
        assert [r[f"above{i}"] for i in range(3)] == [want > t for t in (0.15, 0.3, 0.6)], (r["a"], r["b"])


def test_trigram_codes_tell_trigrams_apart(spark):
    rows = spark.createDataFrame([("São 日本 a1",), ("\U00020000x",), ("",), (None,)], "t string")
    for r in rows.select(text.trigrams(F.col("t")).alias("t"), text.trigram_codes(F.col("t")).alias("c")).collect():
        assert (r["t"] is None) == (r["c"] is None)
        for g, code in zip(r["t"] or [], r["c"] or [], strict=True):
            assert code == sum(ord(x) << s for x, s in zip(g, (42, 21, 0), strict=True))


def test_slugs(spark):
    assert value(spark, text.slug(lit(" Exposição: Água & Luz! "))) == "exposicao-agua-luz"
    assert value(spark, text.event_slug(lit("!!!"), lit("s"), lit("1"))) == value(spark, F.substring(F.sha2(lit("s:1"), 256), 1, 8))


def test_urls(spark):
    assert value(spark, text.normalize_url(lit(" HTTPS://X.example/a// "))) == "https://x.example/a"
    assert [value(spark, text.is_http_url(lit(u))) for u in ("https://x.example", "ftp://x.example", "no url", None)] == [True, False, False, False]
    assert value(spark, text.external_id_of(lit(" "), lit("https://x.example/evento/abc/"))) == "abc"


def test_calendar_dates(spark):
    assert [value(spark, temporal.is_calendar_date(lit(d))) for d in ("2026-02-28", "2026-02-30", "2026-2-1", None)] == [True, False, False, False]


def test_local_date_and_missing_midnight(spark):
    assert str(value(spark, temporal.local_date(lit("2026-01-05 02:00:00")))) == "2026-01-04"
    at = temporal.effective_instant(lit("date"), F.lit(None).cast("timestamp"), lit("2018-11-04").cast("date"))
    assert value(spark, F.date_format(at, "HH:mm")) == "03:00"


def test_weekend_on_sunday_is_the_current_one(spark):
    r = value(spark, temporal.period_range(lit("weekend"), lit("2026-01-05 01:00:00")))
    assert (str(r["start"]), str(r["end"])) == ("2026-01-03", "2026-01-04")
    assert value(spark, temporal.period_range(lit("someday"), lit("2026-01-05 01:00:00"))) is None


def test_date_range_errors(spark):
    def code(period, start, end):
        return value(spark, temporal.date_range_error(*(F.lit(x).cast("string") for x in (period, start, end))))

    assert code("today", "2026-01-01", None) == "invalid-filter-combination"
    assert code(None, "2026-01-01", None) == "invalid-filter-combination"
    assert code("noon", None, None) == "invalid-period"
    assert code(None, "2026-01-02", "2026-01-01") == "invalid-date"
    assert code(None, None, None) is None


def test_distances(spark):
    a = [lit(x) for x in (-30.0346, -51.2177, -30.0654, -51.2300)]
    sphere, earth = value(spark, geo.haversine(*a)), value(spark, geo.ellipsoidal(*a))
    assert abs(sphere - earth) / earth < 0.003
    none = F.lit(None).cast("double")
    assert value(spark, geo.haversine(none, *a[1:])) is None
    assert value(spark, geo.ellipsoidal(none, *a[1:])) is None
    assert value(spark, geo.ellipsoidal(a[0], a[1], a[0], a[1])) == 0.0


def test_a_long_text_has_the_trigrams_of_its_words_once(spark):
    from listwright.functions import text

    row = spark.range(1).select(F.repeat(F.lit("Show de rock, "), 500).alias("a"), F.lit("rock de show").alias("b"))
    got = row.select(F.size(text.trigrams(F.col("a"), once=True)).alias("n"), text.similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert (got["n"], got["s"]) == (13, 1.0)
