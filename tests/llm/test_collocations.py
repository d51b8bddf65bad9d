"""Collocations against a count of all runs, with odd rows, hot words and streams cut anywhere."""

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from listwright.llm import collocations
from listwright.llm.queries import ORACLE_OP12

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, most, held):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {}
    for key, a in f.items():
        if len(key) > 2 and a >= least:
            lang, *w = key
            cuts = [(1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[key] = (a, f[lang, *w[:k]], f[lang, *w[k:]], score)
    longest = Counter()
    for key, (a, *_) in found.items():
        if len(key) == 4:
            for part in ((key[0], *key[1:3]), (key[0], *key[2:4])):
                longest[part] = max(longest[part], a)
    out = []
    for lang in n:
        own = [(key, v) for key, v in found.items() if key[0] == lang and 100 * longest[key] < held * v[0]]
        own.sort(key=lambda x: (-x[1][3], -x[1][0], " ".join(x[0][1:]).encode()))
        out += [(lang, i, " ".join(key[1:]), a, left, right, n[lang], score) for i, (key, (a, left, right, score)) in enumerate(own[:most], 1)]
    return sorted(out)


def corpus():
    draw = np.random.default_rng(2)
    words = ["the", "The", "of", "ÉÜ", "a\x01", "a", "a\x1c", "é", "b c", "日本", "-", "\x0e", "x'y", "İ"]
    rows = []
    for i in range(240):
        picked = draw.choice(words, int(draw.integers(0, 60)), p=[0.3] + [0.7 / 13] * 13)
        gaps = draw.choice([" ", "  ", "\t", ". ", ",", "\n", " ;", "\r\n", "!?", "\x0b"], len(picked), p=[0.6, 0.1, 0.1, 0.05, 0.03, 0.03, 0.03, 0.02, 0.02, 0.02])
        rows.append((i, "".join(w + g for w, g in zip(picked, gaps, strict=True)), [None, "en", "", "de", "und"][i % 5], "clash", i))
    rows += [(900, "New York City hall. " * 40, "en", "", 0), (901, None, "en", "", 0), (902, "", None, None, None), (None, " \t.\n", "fr", "", 0), (903, "alone", "it", "", 0)]
    rows += [rows[1]] * 3 + [(904 + i, "we saw New York today", "en", "", 0) for i in range(15)]
    return rows


@pytest.mark.parametrize(("least", "most", "held"), [(10, 2000, 50), (2, 30, 50), (1, 2000, 100)])
def test_as_brute_force(spark, monkeypatch, least, most, held):
    monkeypatch.setattr(collocations, "SLICE", 900)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(tuple(r) for r in collocations.collocations(df, least, most, held).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute(rows, least, most, held)


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_bits_change_nothing(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(collocations, "pair_bitmap", lambda _: b"\xff" * (collocations.FILTER // 8))
    got = sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows, 10, 2000, 50)


@pytest.mark.parametrize("cut", [1, 2, 3, 7, 1000])
def test_pass_with_batches_of_any_size(cut):
    draw = np.random.default_rng(cut)
    phrases = sorted({tuple(draw.choice(list("abcd"), int(k))) for k in draw.integers(1, 4, 200)} | {(x,) for x in "abcd"} | {(x, y) for x in "abcd" for y in "abcd"})
    f = {p: int(draw.integers(1, 1000)) for p in phrases}
    whole = pa.RecordBatch.from_arrays([pa.array([" ".join(p) for p in phrases]), pa.array([len(p) for p in phrases], pa.int32()), pa.array([f[p] for p in phrases])], names=["words", "size", "f"])
    got = {}
    for batch in collocations.in_step(whole.slice(i, cut) for i in range(0, len(phrases), cut)):
        for r in batch.to_pylist():
            p = tuple(r["words"].split())
            assert p not in got
            got[p] = r
    assert set(got) == set(phrases)
    for p, r in got.items():
        assert r["by_one"] == f[p[:1]]
        if len(p) > 1:
            assert r["by_two"] == f[p[:2]]
        if len(p) == 2:
            assert r["extension"] == max((v for q, v in f.items() if len(q) == 3 and q[:2] == p), default=0)


def test_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(ORACLE_OP12).fetchall())
    got = sorted(tuple(r) for r in collocations.collocations(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    assert got == want and len(got) > 100
