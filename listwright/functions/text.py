"""Text functions as Column expressions: normal forms, tokens, slugs, URLs, trigrams."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Function words that carry no meaning in a title.
STOPWORDS = ["a", "as", "o", "os", "de", "da", "do", "das", "dos", "e", "em", "na", "no", "nas", "nos", "um", "uma"]


def _accents() -> tuple[str, str]:
    """Letters of all scripts whose canonical decomposition is one other letter and marks, and that letter."""
    plain = {}
    for code in range(0x00C0, 0x10000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.category(c).startswith("M"))
        if len(base) == 1 and base != chr(code):
            plain[chr(code)] = base
    return "".join(plain), "".join(plain.values())


ACCENTED, PLAIN = _accents()


def strip_accents(c: Column) -> Column:
    """Without combining marks: letters by a table, loose marks by their class. JVM only; syllables of Hangul stay whole."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}+", "")


@F.pandas_udf(T.StringType())
def strip_accents_unicode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The same with Hangul in its parts, by full decomposition in Arrow batches."""
    for own in batches:
        yield own.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.category(c).startswith("M")))


def normalize_text(c: Column, full_unicode: bool = False) -> Column:
    plain = strip_accents_unicode(c) if full_unicode else strip_accents(c)
    words = F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def tokenize(c: Column) -> Column:
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def significant_tokens(c: Column) -> Column:
    return F.array_except(F.array_distinct(tokenize(c)), F.array(*map(F.lit, STOPWORDS)))


def token_similarity(a: Column, b: Column) -> Column:
    """The larger of Dice and overlap coefficient of the significant tokens; 0 if a side has none."""

    def of(both: Column) -> Column:
        x, y = both["x"], both["y"]
        shared, n, m = F.size(F.array_intersect(x, y)), F.size(x), F.size(y)
        return F.when((n <= 0) | (m <= 0), F.lit(0.0)).otherwise(F.greatest(2.0 * shared / (n + m), shared / F.least(n, m)))

    return let(F.struct(significant_tokens(a).alias("x"), significant_tokens(b).alias("y")), of)


def slug(c: Column) -> Column:
    words = F.regexp_replace(F.trim(F.lower(strip_accents(c))), "[^a-z0-9]+", "-")
    return F.regexp_replace(words, "^-+|-+$", "")


def event_slug(title: Column, source_id: Column, external_id: Column) -> Column:
    suffix = F.substring(F.sha2(F.concat_ws(":", source_id, external_id), 256), 1, 8)
    return F.concat_ws("-", F.nullif(slug(title), F.lit("")), suffix)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def normalize_url(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "/+$", "")


def is_http_url(c: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(c, F.lit("HOST")).isNotNull(), F.lit(False))


def external_id_of(given: Column, url: Column) -> Column:
    """The trimmed id, else the last segment of /evento/<slug>/."""
    return F.coalesce(blank_to_null(given), F.nullif(F.regexp_extract(F.trim(url), "/evento/([^/]+)/?$", 1), F.lit("")))


def trigrams(c: Column, once: bool = False) -> Column:
    """Trigrams in order, repeats included: words lower-cased, two blanks before and one after each. once: of each word
    once, which has the same set and is much less for a long text."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    words = F.array_distinct(words) if once else words
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all distinct trigrams."""

    def of(both: Column) -> Column:
        shared = F.size(F.array_intersect(both["x"], both["y"]))
        every = F.size(both["x"]) + F.size(both["y"]) - shared
        return F.when(every == 0, F.lit(0.0)).otherwise(shared / every)

    both = F.struct(F.array_distinct(trigrams(a, once=True)).alias("x"), F.array_distinct(trigrams(b, once=True)).alias("y"))
    return F.when(a.isNotNull() & b.isNotNull(), let(both, of))


def substring_grams(c: Column, longest: int = 3) -> Column:
    """All distinct runs of one to `longest` characters, lower-cased: a text that contains a term has the term's."""
    runs = lambda low, n: F.regexp_extract_all(low, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))
    return let(F.lower(c), lambda low: F.array_distinct(F.concat(*(runs(low, n) for n in range(1, longest + 1)))))


def term_grams(c: Column, longest: int = 3) -> Column:
    """The substring grams of a term that a text which contains it must have: those of `longest` characters, or the whole
    of a shorter term."""
    return F.filter(substring_grams(c, longest), lambda g: F.char_length(g) == F.least(F.lit(longest), F.char_length(F.lower(c))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value made once: a lambda's argument is, an expression would be made anew in each place."""
    return F.transform(F.array(value), body)[0]


def trigram_codes(c: Column) -> Column:
    """`trigrams` as whole numbers, one for each: three code points of 21 bits."""
    at = lambda g, i, bits: F.shiftleft(F.ascii(F.substring(g, i, 1)).cast("long"), bits)
    return F.transform(trigrams(c), lambda g: at(g, 1, 42) + at(g, 2, 21) + at(g, 3, 0))


def best_run(query: Column, text: Column) -> Column:
    """The best similarity of a set (an array without repeats) and the set of any run of a list; 0 if nothing is shared.

    One more shared item beside a run makes it better or leaves it as it is, so best runs begin and end where unbroken
    stretches of shared items do: only those are tried. With n items in the set, a run of d different ones has n / d at
    most, which ends a start's runs as soon as that isn't above the best so far.
    """

    def stretches(both: Column) -> Column:
        q, t = both["q"], both["t"]
        hits = F.transform(t, lambda g: F.array_contains(q, g))
        return F.struct(q.alias("q"), t.alias("t"), F.size(q).alias("n"), hits.alias("hits"), F.sequence(F.lit(0), F.size(t)).alias("at"))

    def borders(m: Column) -> Column:
        hit = lambda i: F.coalesce(F.get(m["hits"], i), F.lit(False))
        return F.struct(m["q"].alias("q"), m["t"].alias("t"), m["n"].alias("n"), F.filter(m["at"], lambda i: hit(i) & ~hit(i - 1)).alias("starts"), F.filter(m["at"], lambda i: hit(i) & ~hit(i + 1)).alias("ends"))

    def best(m: Column) -> Column:
        def from_start(so_far: Column, start: Column) -> Column:
            def step(s: Column, end: Column) -> Column:
                def run(own: Column) -> Column:
                    every, shared = own["every"], own["shared"]
                    value = F.greatest(s["best"], shared / (m["n"] + every - shared))
                    return F.struct(value.alias("best"), (every * value >= m["n"]).alias("done"))

                own = let(F.slice(m["t"], start + 1, end - start + 1), lambda w: F.struct(F.size(F.array_distinct(w)).alias("every"), F.size(F.array_intersect(m["q"], w)).alias("shared")))
                return F.when(s["done"], s).otherwise(let(own, run))

            return F.aggregate(F.filter(m["ends"], lambda e: e >= start), F.struct(so_far.alias("best"), F.lit(False).alias("done")), step, lambda s: s["best"])

        return F.aggregate(m["starts"], F.lit(0.0), from_start)

    return let(F.struct(query.alias("q"), text.alias("t")), lambda both: let(stretches(both), lambda m: let(borders(m), best)))


def run_above(query: Column, text: Column, least: float) -> Column:
    """best_run(query, text) > least, by cheaper bounds where they decide: what is shared over the set is an upper one,
    the similarity to the whole list a lower one."""

    def above(m: Column) -> Column:
        n = F.size(m["q"])
        return F.when(m["c"] / F.nullif(n, F.lit(0)) > least, (m["c"] / (n + F.size(F.array_distinct(m["t"])) - m["c"]) > least) | (best_run(m["q"], m["t"]) > least)).otherwise(F.when(m["c"].isNotNull(), F.lit(False)))

    shared = F.when(query.isNotNull() & text.isNotNull(), F.size(F.array_intersect(query, text)))
    return let(F.struct(query.alias("q"), text.alias("t"), shared.alias("c")), above)


def word_similarity(a: Column, b: Column) -> Column:
    """Asymmetric: a's trigrams against the best run of b's. Null where a text is."""
    return F.when(a.isNotNull() & b.isNotNull(), best_run(F.array_distinct(trigrams(a)), trigrams(b)))


def word_similar(a: Column, b: Column, least: float) -> Column:
    """word_similarity(a, b) > least."""
    return F.when(a.isNotNull() & b.isNotNull(), run_above(F.array_distinct(trigrams(a)), trigrams(b), least))


def year_token(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b(19|20)\d{2}\b", 0), F.lit(""))


def contains_ignore_case(c: Column, term: Column) -> Column:
    return F.contains(F.lower(c), F.lower(term))
