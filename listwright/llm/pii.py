"""Operator 11: personal data by weak supervision.

Fixed rules give the base spans, which always stay. Wider rules give further candidates: cards and phones inside longer
runs of numbers, phones without a country code, written-out addresses, long-form network addresses. On every candidate
labelers vote for (1), against (-1) or not at all (0): by its form, by gazetteers (calling codes, card issuers, endings of
domains) and by the words and characters around it. Expectation-maximisation over the counts of all vote patterns, of
which there are 3^8 for each kind at most whatever the corpus, estimates how reliable each labeler is and how likely
each pattern is to be personal data. These probabilities train the final classifier, a logistic regression on a span's
shape, checks and neighbours; candidates that it finds likelier than not are added where they overlap no other span.

The EM takes the votes on all candidates of all documents. The regression is fitted on at most EACH candidates of each
vote pattern (those of smallest hash), weighted by the root of what they stand for. Both run on the driver.

Defined results. Places count code points, ends are exclusive. A null or empty text has no spans. The counts and
base_sha256 are of base spans; `spans` holds all. Repeated rows and null doc_ids get a row each; texts of any length are
read whole, each rule in time proportional to the length. Without candidates nothing is added; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Candidates of a vote pattern that the classifier is fitted on; hashed features; characters of context; least probability.
EACH, DIMENSIONS, AROUND, LIKELY = 50, 1 << 16, 40, 0.5
#: Steps and pseudo-observations of the EM; steps and pull of the regression.
EM_STEPS, TRUST, FIT_STEPS, PULL = 200, 5.0, 400, 1e-3

# The base patterns, possessive where a match never gives back.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMBER = re.compile("[0-9]+")
WORD = re.compile(r"[^\W\d_]+")
#: Wider forms.
HOST = re.compile(r"[A-Za-z0-9-]++(?![A-Za-z0-9.@-])")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)
#: What every spelled-out address has in it, and every number in groups.
SPELLS, GROUPED = (" dot ", "dot]", "dot)", "dot}", "at]", "at)", "at}"), re.compile(r"[0-9]{3,4}[\x20.-][0-9]{3,4}")
SIX = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+().-])(?:00[1-9][0-9]{0,2}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])")
GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)}

# Calling codes of one to three digits; first digits and lengths of card issuers; endings of domains.
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ISSUERS = (("4", (13, 16, 19)), ("51", (16,)), ("52", (16,)), ("53", (16,)), ("54", (16,)), ("55", (16,)), ("34", (15,)), ("37", (15,)), ("36", (14,)), ("6011", (16, 19)), ("65", (16, 19)), ("35", (16,)), ("62", (16, 17, 18, 19)))
ENDINGS = frozenset("com org net edu gov int info io me biz de fr es it uk nl be at ch se no dk fi pl pt br mx ar cl us ca au nz jp cn in ru".split())
CUES = (
    frozenset("email mail mailto contact write courriel correo adresse".split()),
    frozenset("ip host address server client from adresse peer".split()),
    frozenset("card visa mastercard amex credit debit karte carte tarjeta pan payment".split()),
    frozenset("phone tel telephone call mobile cell fax contact whatsapp telefon telefono".split()),
)
COUNTER_CUES = frozenset("version release build isbn issn doi order invoice serial sku ref reference hash token key chapter section figure id".split())


# base spans


def emails(text: str) -> list[tuple[int, int]]:
    """A match begins where the run of characters before an @ begins, or where the last match ended."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def octets(quad: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in quad.split("."))


def digits_of(span: str) -> str:
    return "".join(NUMBER.findall(span))


def luhn(digits: str) -> bool:
    own = [ord(c) - 48 for c in reversed(digits)]
    return (sum(own[::2]) + sum(2 * d - 9 * (d > 4) for d in own[1::2])) % 10 == 0


def is_card(span: str) -> bool:
    digits = digits_of(span)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(span: str) -> bool:
    return 9 <= len(digits_of(span)) <= 15


def runs(text: str) -> tuple[list[re.Match], list[re.Match], list[re.Match]]:
    """Matches of the digit patterns before their checks: (quads, digit runs, plus runs)."""
    return list(QUAD.finditer(text)) if text.count(".") >= 3 else [], list(DIGITS.finditer(text)), list(PLUS.finditer(text)) if "+" in text else []


def base_spans(text: str, found: tuple[list[re.Match], list[re.Match], list[re.Match]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start and kind."""
    quads, digits, plus = found
    spans = [(a, EMAIL, b) for a, b in emails(text)] if "@" in text else []
    spans += [(m.start(), IP, m.end()) for m in quads if octets(m.group())]
    spans += [(m.start(), CARD, m.end()) for m in digits if m.end() - m.start() > 11 and is_card(m.group())]
    spans += [(m.start(), PHONE, m.end()) for m in plus if is_phone(m.group())]
    return sorted(spans)


# wider candidates


def more_spans(text: str, found: tuple[list[re.Match], list[re.Match], list[re.Match]], base: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the base rules don't give, well-formed or not; they may overlap."""
    quads, digits, plus = found
    out: set[tuple[int, int, int]] = set()
    for m in digits:
        if m.end() - m.start() > 11:
            out.update(cards_within(m.group(), m.start()))
    for m in plus:
        if (m.start(), PHONE, m.end()) not in base:
            out.update(phones_within(m.group(), m.start()))
    out.update((m.start(), IP, m.end()) for m in quads)
    if digits and GROUPED.search(text):
        out.update((m.start(), PHONE, m.end()) for m in NATIONAL.finditer(text) if written_as_phone(text, m))
    if text.count(":") >= 7:
        out.update((m.start(), IP, m.end()) for m in SIX.finditer(text))
    at = text.find("@")
    while at >= 0:
        host = HOST.match(text, at + 1)
        start = at
        while start > at - 64 and start > 0 and text[start - 1] in LOCAL:
            start -= 1
        if host and start < at:
            out.add((start, EMAIL, host.end()))
        at = text.find("@", at + 1)
    low = text.lower()
    if any(x in low for x in SPELLS):
        out.update((m.start(), EMAIL, m.end()) for m in SPELLED.finditer(text) if any(x in m.group().lower() for x in SPELLS))
    return sorted(out - covered(out, base))


def covered(spans: set[tuple[int, int, int]], base: set[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
    """Those of the spans that lie within a base span."""
    order = sorted((a, b) for a, _, b in base)
    starts = [a for a, _ in order]
    furthest = list(accumulate((b for _, b in order), max))
    return {s for s in spans if (at := bisect_right(starts, s[0])) and furthest[at - 1] >= s[2]}


def written_as_phone(text: str, match: re.Match) -> bool:
    """Numbers parted by blanks alone are many things: they need a word for phones before them."""
    span = match.group()
    if span.startswith(("00", "(")) or len(set(re.findall("[.-]", span))) == 1 and " " not in span:
        return True
    return any(w.lower() in CUES[PHONE] for w in WORD.findall(text[max(0, match.start() - AROUND) : match.start()])[-4:])


def cards_within(run: str, start: int) -> Iterator[tuple[int, int, int]]:
    """Groups of a run that are grouped as cards are, or single groups of 12 to 19 digits."""
    groups = [m.span() for m in NUMBER.finditer(run)]
    sizes = [b - a for a, b in groups]
    for i, size in enumerate(sizes):
        if 12 <= size <= 19:
            yield start + groups[i][0], CARD, start + groups[i][1]
        for n in (3, 4, 5):
            if n <= len(sizes) - i and tuple(sizes[i : i + n]) in GROUPS:
                yield start + groups[i][0], CARD, start + groups[i + n - 1][1]


def phones_within(run: str, start: int) -> Iterator[tuple[int, int, int]]:
    """Beginnings of a run that end with a group and have as many digits as phones have."""
    n = 0
    for m in NUMBER.finditer(run):
        n += m.end() - m.start()
        if n > 15:
            return
        if n >= 9:
            yield start, PHONE, start + m.end()


# labelers


def checked(kind: int, span: str) -> int:
    """The vote of a kind's own check, on base spans and others alike."""
    if kind == CARD:
        return 1 if is_card(span) else -1
    if kind == IP:
        return 1 if ":" in span or octets(span) else -1
    if kind == PHONE:
        return 1 if is_phone(span) and span[0] == "+" else 0 if is_phone(span) else -1
    if "@" not in span:  # spelled out: its end must be known
        return 0 if listed(kind, span) > 0 else -1
    return 1 if DOMAIN.fullmatch(span.rpartition("@")[2]) else -1


def grouped(kind: int, span: str) -> int:
    """Whether the parts have usual lengths."""
    sizes = tuple(map(len, NUMBER.findall(span)))
    if kind == CARD:
        return 1 if sizes in GROUPS or (len(sizes) == 1 and sizes[0] in (13, 14, 15, 16, 19)) else -1
    if kind == PHONE:
        return 1 if 2 <= len(sizes) <= 6 and max(sizes) <= 7 or sizes == (len(span) - 1,) else -1
    if kind == IP:
        return 1 if ":" in span or all(s <= 3 for s in sizes) else -1
    return -1 if ".." in span or span[0] in ".-" else 1


def listed(kind: int, span: str) -> int:
    """The gazetteers."""
    if kind == EMAIL:
        last = WORD.findall(span)
        return 1 if last and last[-1].lower() in ENDINGS else -1
    digits = digits_of(span)
    if kind == CARD:
        return 1 if any(digits.startswith(p) and len(digits) in sizes for p, sizes in ISSUERS) else -1
    if kind == PHONE:
        digits = digits[2:] if digits.startswith("00") else digits
        coded = span[0] == "+" or digits_of(span).startswith("00")
        return (1 if any(digits[:k] in CALLING_CODES for k in (1, 2)) else -1) if coded else 0
    first = NUMBER.match(span)
    return 0 if ":" in span else 1 if first and 1 <= int(first.group()[:4]) <= 223 else -1


def varied(kind: int, span: str) -> int:
    """Against made-up values: one digit throughout, leading zeros in an address, no letter in a name."""
    if kind == EMAIL:
        return 1 if WORD.search(span) else -1
    if kind == IP:
        return 1 if ":" in span or all(p == "0" or p[0] != "0" for p in span.split(".")) else -1
    return 1 if len(set(digits_of(span))) > 2 else -1


def votes(kind: int, text: str, start: int, end: int) -> tuple[int, ...]:
    span, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    near = {w.lower() for w in WORD.findall(before)[-4:]}
    left, right = before[-1:], after[:1]
    glued = left.isalnum() or left in ("_", "/", "#") or right.isalnum() or right in ("_", "/", "@") or (right in (".", "-") and after[1:2].isalnum())
    assigned = before.rstrip(" \"'")[-1:] in ("=", "&") and bool(before)
    return (
        checked(kind, span), grouped(kind, span), listed(kind, span), varied(kind, span), 1 if near & CUES[kind] else 0, -1 if near & COUNTER_CUES else 0,
        -1 if glued else 1, -1 if assigned else 0,
    )


def features(kind: int, text: str, start: int, end: int) -> list[int]:
    """Hashed features of a span for the classifier: its shape, what its checks say, its neighbours."""
    span, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", span))
    sign = lambda c: "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c.isspace() else c
    found = ["", f"shape {shape[:40]}", f"form {re.sub('9+', '9', shape)[:40]}", f"n {len(digits_of(span))}", f"left {sign(before[-1:])}", f"right {sign(after[:1])}"]
    found += [f"{name} {vote}" for name, vote in zip(("checked", "grouped", "listed", "varied"), (f(kind, span) for f in (checked, grouped, listed, varied)), strict=True)]
    found += [f"before {w.lower()}" for w in WORD.findall(before)[-3:]] + [f"after {w.lower()}" for w in WORD.findall(after)[:2]]
    return sorted({zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % DIMENSIONS for x in found})


# expectation-maximisation


def reliabilities(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each vote pattern to be of class 1, table [class, labeler, vote + 1]) of one kind.

    Labelers vote independently given the class. A labeler can't be worse than chance: where its votes for are no likelier
    in class 1, or those against no likelier in class 0, they count for nothing. TRUST pseudo-observations of each
    labeler in each class lean towards its vote being right.
    """
    n, labelers = patterns.shape
    vote = np.eye(3)[patterns + 1]
    prior = TRUST * np.array([[3, 2, 1], [1, 2, 3]]) / 6.0
    likely = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    table = np.full((2, labelers, 3), 1 / 3)
    for _ in range(EM_STEPS):
        for y, own in ((0, 1 - likely), (1, likely)):
            table[y] = prior[y] + np.einsum("p,plv->lv", counts * own, vote)
            table[y] /= table[y].sum(axis=1, keepdims=True)
        for v, better in ((2, 1), (0, 0)):
            odd = table[better, :, v] < table[1 - better, :, v]
            table[:, odd, v] = table[:, odd, v].mean(axis=0)
        table /= table.sum(axis=2, keepdims=True)
        share = (counts @ likely + TRUST) / (counts.sum() + 2 * TRUST)
        odds = np.log(share / (1 - share)) + np.einsum("plv,lv->p", vote, np.log(table[1]) - np.log(table[0]))
        after = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        done = np.abs(after - likely).max() < 1e-9
        likely = after
        if done:
            break
    return likely, table


@dataclass(frozen=True)
class Classifier:
    """Weights of hashed features, and each labeler's estimated reliabilities by kind."""

    weights: dict[int, float]
    labelers: dict[int, np.ndarray]

    def probability(self, has: list[int]) -> float:
        return 1 / (1 + float(np.exp(-sum(self.weights.get(i, 0.0) for i in has))))


def regression(rows: list[list[int]], target: np.ndarray, weight: np.ndarray) -> dict[int, float]:
    """Weighted logistic regression on probabilities, by gradient steps of adapted size."""
    if not rows:
        return {}
    col = np.concatenate([np.array(r, np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    known, at = np.unique(col, return_inverse=True)
    w, sums, weight = np.zeros(len(known)), np.full(len(known), 1e-8), weight / weight.sum()
    for _ in range(FIT_STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at], len(rows)), -40, 40)))
        slope = np.bincount(at, (weight * (p - target))[row], len(known)) + PULL * w / len(rows)
        sums += slope**2
        w -= 0.5 * slope / np.sqrt(sums)
    return dict(zip(known.tolist(), w.tolist(), strict=True))


# the operator


CANDIDATES = "kind int, votes string, key long, features array<int>"


def by_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def candidate_rows(docs: DataFrame) -> DataFrame:
    """(kind, votes, key, features) of every candidate of every document; key is a hash to choose by."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(0).to_pylist():
                found = runs(text)
                base = base_spans(text, found)
                for start, kind, end in [*base, *more_spans(text, found, set(base))]:
                    key = zlib.crc32(f"{start} {len(text)} {text[max(0, start - AROUND) : end]}".encode("utf-8", "surrogatepass"))
                    out.append((kind, "".join("-0+"[v + 1] for v in votes(kind, text, start, end)), key, features(kind, text, start, end)))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "votes", "key", "features"])

    return by_text(docs).select("text").mapInArrow(rows, CANDIDATES)


def fit(docs: DataFrame, each: int = EACH) -> Classifier:
    """The EM over all candidates' votes, and the classifier that its probabilities train."""
    rows = written(candidate_rows(docs), "pii-candidates")
    patterns = rows.groupBy("kind", "votes").count().orderBy("kind", "votes").collect()  # 4 * 3^8 at most
    likely: dict[tuple[int, str], float] = {}
    counts = {(r["kind"], r["votes"]): r["count"] for r in patterns}
    labelers = {}
    for kind in sorted({k for k, _ in counts}):
        own = [v for k, v in counts if k == kind]
        signs = np.array([["-0+".index(c) - 1 for c in v] for v in own])
        p, labelers[kind] = reliabilities(signs, np.array([counts[kind, v] for v in own], float))
        likely |= {(kind, v): x for v, x in zip(own, p.tolist(), strict=True)}
    order = Window.partitionBy("kind", "votes").orderBy("key", "features")
    sample = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).drop("_n", "key").orderBy("kind", "votes", "features").collect()
    taken: dict[tuple[int, str], int] = {}
    for r in sample:
        taken[r["kind"], r["votes"]] = taken.get((r["kind"], r["votes"]), 0) + 1
    keys = [(r["kind"], r["votes"]) for r in sample]
    weight = np.array([(counts[k] / taken[k]) ** 0.5 for k in keys])
    return Classifier(regression([r["features"] for r in sample], np.array([likely[k] for k in keys]), weight), labelers)


def all_spans(text: str, base: list[tuple[int, int, int]], more: list[tuple[int, int, int]], classifier: Classifier) -> list[tuple[int, int, int]]:
    """Base spans, and of the others the likely ones that overlap nothing, the likeliest and then the first and longest
    first. What its kind's own check refuses isn't added, however likely."""
    good = [x for x in more if checked(x[1], text[x[0] : x[2]]) >= 0]
    rated = sorted((-p, start, -end, kind) for start, kind, end in good if (p := classifier.probability(features(kind, text, start, end))) >= LIKELY)
    chosen = list(base)
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in base:  # base spans of two kinds may overlap
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for _, start, end, kind in rated:
        at = bisect_left(starts, -end)
        if at == 0 or ends[at - 1] <= start:
            chosen.append((start, kind, -end))
            starts.insert(at, start)
            ends.insert(at, -end)
    return sorted(chosen)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def tagged(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                found = runs(text)
                base = base_spans(text, found)
                more = more_spans(text, found, set(base))
                spans = all_spans(text, base, more, own) if more else base
                n = [sum(kind == k for _, kind, _ in base) for k in range(4)]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds: list[Callable] = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=names)

    return by_text(docs).mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def personal_data(docs: DataFrame) -> DataFrame:
    return tagged(docs, fit(docs))
