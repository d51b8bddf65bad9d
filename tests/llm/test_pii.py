"""Personal data: base spans against the plain patterns, the EM against known reliabilities, added spans on planted cases."""

import hashlib
import re
import time

import numpy as np
import pytest

from listwright.llm import pii

SCHEMA = "doc_id long, text string, lang string, n_email string, spans long"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, span):
    digits = [int(c) for c in span if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    text = text or ""
    spans = [(m.start(), i, m.end()) for i, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(kind, m.group())]
    named = [f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(spans)]
    return (*(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(",".join(named).encode()).hexdigest()), named


def fuzz(n=3000):
    draw = np.random.default_rng(6)
    parts = ["@", ".", "a", "b.c", "1", "12", "255", "256", "4111111111111111", "+", " ", "-", "(", ")", "+1 (487) 555-7209", "x@y.zz", "10.0.0.1", "é", "\n", "007", "%", "_", "@@", "9" * 12, "0" * 16, "٣"]
    return ["".join(draw.choice(parts, int(draw.integers(0, 14)))) for _ in range(n)]


def corpus():
    rows = [(i, t, "en", "clash", 0) for i, t in enumerate(fuzz(400))]
    return rows + [(900, None, None, None, None), (901, "", "en", "", 0), (None, "me@x.org", "en", "", 0), rows[5], rows[5], (902, "word " * 30000 + "me@x.org " + "1.2.3.4 " * 3000, "en", "", 0)]


def test_base_as_plain_patterns():
    for text in fuzz():
        found = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(text, pii.runs(text))]
        assert found == brute(text)[1], text


def test_rows_as_brute_force(spark):
    rows = corpus()
    got = sorted((tuple(r) for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()), key=repr)
    want = {(r[0], r[1]): brute(r[1]) for r in rows}
    assert sorted((r[:6] for r in got), key=repr) == sorted(((r[0], *brute(r[1])[0]) for r in rows), key=repr)
    for r in got:
        own = [w for (i, _), w in want.items() if i == r[0]][0]
        assert set(own[1]) <= set(filter(None, r[6].split(",")))
        ends = [(int(a), int(b)) for _, a, b in (x.split(":") for x in r[6].split(",") if x not in own[1] and x)]
        assert all(b <= c for (_, b), (c, _) in zip(sorted(ends), sorted(ends)[1:], strict=False))


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def card(draw):
    digits = [4, *draw.integers(0, 10, 14).tolist()]
    last = next(d for d in range(10) if pii.luhn("".join(map(str, [*digits, d]))))
    return "".join(map(str, [*digits, last]))


def test_added_spans(spark):
    """Cards side by side, a phone before other numbers, spelled-out and long-form addresses are found; the rest stays clean."""
    draw = np.random.default_rng(3)
    rows, hidden, clean = [], {}, []
    fill = lambda: " ".join(draw.choice("one two three the house of a year was on".split(), 12))
    for i in range(0, 800, 8):
        a, b = card(draw), card(draw)
        phone = f"+1 ({draw.integers(200, 999)}) 555-{draw.integers(1000, 9999)}"
        cases = [
            (f"{fill()} {a} {fill()} {phone} {fill()} me{i}@mail.example.com and 10.2.{i % 250}.7", []),
            (f"{fill()} {a} {b} {fill()}", [f"card:{{}}:{a}", f"card:{{}}:{b}"]),
            (f"{fill()} {phone} {a} {fill()}", [f"phone:{{}}:{phone}", f"card:{{}}:{a}"]),
            (f"{fill()} write to jane{i} [at] mail [dot] org {fill()}", [f"email:{{}}:jane{i} [at] mail [dot] org"]),
            (f"{fill()} phone (487) 555-{draw.integers(1000, 9999)} {fill()}", None),
            (f"{fill()} version 300.400.500.600 of 12 345 678 901 {fill()} 2024-01-15 10:00 look at the dot {fill()}", []),
            (f'{fill()} token = "9{a}{b}77a" {fill()}', []),
            (fill(), []),
        ]
        for k, (text, spans) in enumerate(cases):
            rows.append((i + k, text, "en", "", 0))
            hidden[i + k] = spans
            if k in (5, 6, 7):
                clean.append(i + k)
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    texts = {r[0]: r[1] for r in rows}
    missed = 0
    for i, spans in hidden.items():
        found = {x for x in got[i]["spans"].split(",") if x}
        assert set(brute(texts[i])[1]) <= found
        for s in spans or []:
            kind, _, value = s.partition(":{}:")
            at = texts[i].index(value)
            missed += f"{kind}:{at}:{at + len(value)}" not in found
        if spans is None:
            missed += not any(x.startswith("phone:") for x in found)
    assert missed <= 0.02 * len(rows)
    assert all(got[i]["spans"] == "" for i in clean)


def test_em_finds_reliabilities():
    draw = np.random.default_rng(1)
    n = 20000
    truth = draw.random(n) < 0.6
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    cast = draw.random((n, 5)) < np.array([1.0, 0.8, 0.9, 0.5, 1.0])
    ok = draw.random((n, 5)) < right
    vote = np.where(cast, np.where(ok == truth[:, None], 1, -1), 0)
    patterns, which, counts = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    likely, table = pii.reliabilities(patterns, counts.astype(float))
    assert ((likely[which.ravel()] > 0.5) == truth).mean() > 0.95
    for k in range(5):
        assert table[1, k, 2] / (table[1, k, 2] + table[1, k, 0]) == pytest.approx(right[k], abs=0.03)


def test_long_runs_take_linear_time():
    for text in ("9" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1." * 100_000, "(" * 200_000, "a at " * 40_000 + " dot ", "12 " * 60_000, "1:" * 100_000, "@a" * 50_000, "4111 1111 1111 1111 " * 5_000):
        began = time.perf_counter()
        found = pii.runs(text)
        base = pii.base_spans(text, found)
        more = pii.more_spans(text, found, set(base))
        pii.all_spans(text, base, more, pii.Classifier({}, {}))
        assert time.perf_counter() - began < 5, text[:20]
