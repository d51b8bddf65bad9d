"""Vector searches against brute force; classifiers by held-out accuracy."""

import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.llm import hnsw, quality, topk, toxicity

SF = "/root/testdata/sf0.1"
VECTORS = "vec_id long, embedding array<float>, label int, v string"


def vectors():
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(0, 0.2, 16).astype(np.float32).tolist(), 0, "clash") for i in range(600)]
    same = rows[0][1]
    rows += [(600 + i, same, 0, None) for i in range(60)]  # ties
    rows += [rows[5], (700, None, 0, None), (701, [0.0] * 16, 0, None), (702, [float("nan")] * 16, 0, None), (703, [None] * 16, 0, None), (704, [], 0, None), (705, [1.0, 2.0], 0, None), (None, same, 0, None), (800, [float("inf")] * 16, 0, None)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), VECTORS).repartition(3)


def good(rows, zero):
    return [(i, np.array(e, float)) for i, e, *_ in rows if i is not None and e and None not in e and np.isfinite(e).all() and (zero or np.any(e))]


def brute(rows, every, k, score):
    out = []
    for q, x in {i: x for i, x in rows if i % every == 0}.items():
        best = sorted((score(x, y), i) for i, y in rows if i != q and len(x) == len(y))[:k]
        out += [(q, n, i, s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_is_exact(table):
    v = topk.quantized(table)
    got = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect())
    own = [(i, np.floor(256 * x)) for i, x in good(vectors(), True)]
    assert got == [(q, n, i, int(-s)) for q, n, i, s in brute(own, 50, 5, lambda x, y: -int(x @ y))]


def test_top_k_with_few_candidates(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    v = topk.quantized(few)
    assert [tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect()] == [(0, 1, 1, 256 * 256 * 5)]
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_hnsw_recall_and_scores(table):
    v = hnsw.nonzero(table)
    got = hnsw.search(hnsw.build_index(v), v.where("vec_id % 100 = 0"), 10).collect()
    own = good(vectors(), False)
    want = brute(own, 100, 10, lambda x, y: float(np.sqrt(((x - y) ** 2).sum())))
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(found & {(q, i) for q, _, i, _ in want}) >= 0.9 * len({(q, i) for q, _, i, _ in want})
    by_id = {i: x for i, x in own}
    for r in got:
        assert r["score"] == pytest.approx(float(np.sqrt(((by_id[r["query_id"]] - by_id[r["vec_id"]]) ** 2).sum())), abs=1e-12)
    ties = sorted(r["vec_id"] for r in got if r["query_id"] == 0)
    assert ties == list(range(600, 610))  # equal vectors: the smallest ids
    assert hnsw.search(hnsw.build_index(v.limit(0)), v.limit(0), 10).count() == 0


def labelled(spark, n=600):
    draw = np.random.default_rng(9)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = draw.choice(plain, 60).tolist()
        bad, junk = i % 5 == 0, i % 4 == 0
        if bad:
            w[int(draw.integers(60))] = "scumbag"
        docs.append((i, " ".join(x + "###" for x in w) if junk else " ".join(w), "en", "s"))
        labels.append((i, 0 if junk else 1, int(bad)))
    docs += [(n, None, None, None), (n + 1, "", None, None), (None, "word1 scumbag", None, None), docs[0]]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, lang string"), spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


def test_classifiers_learn_without_held_out_labels(spark):
    docs, labels = labelled(spark)
    graded = quality.graded(docs, labels).collect()
    assert len(graded) == 604
    for r in graded:
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            assert r["selected"] == (r["doc_id"] % 4 != 0)
            assert 0 <= r["tail_probability"] <= 1
    toxic = toxicity.toxicity(docs, labels).collect()
    assert len(toxic) == 604
    for r in toxic:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert r["predicted"] == int(r["doc_id"] % 5 == 0)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {(r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, flipped).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in toxic}


def test_three_grades_are_ordered(spark):
    rows = [(i, " ".join([("good", "fair", "poor")[i % 3]] * 5 + [f"w{i % 50}"] * 5)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 2 - i % 3) for i in range(600)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert list(model.grades) == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = quality.scored(docs, model).select("doc_id", "expected_grade").collect()
    assert all(abs(r["expected_grade"] - (2 - r["doc_id"] % 3)) < 0.4 for r in got)


def test_no_labels_and_no_documents(spark):
    docs, labels = labelled(spark, 40)
    none = labels.limit(0)
    assert quality.graded(docs, none).where("not selected").count() == 0
    assert toxicity.toxicity(docs, none).where("score > 0.01").count() == 0
    assert quality.graded(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_pairs_of_words_are_learnt(spark):
    """Labels that neither of two words tells alone: the exclusive or of both, and an insult beside a group's name."""
    draw = np.random.default_rng(3)
    rows, either, both = [], [], []
    for i in range(2400):
        a, b = draw.random(2) < 0.4
        w = draw.choice([f"word{k}" for k in range(300)], 40).tolist() + ["alpha"] * int(a) + ["beta"] * int(b)
        draw.shuffle(w)
        rows.append((i, " ".join(w)))
        either.append((i, int(a != b)))
        both.append((i, int(a and b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for made in (either, both):
        labels = spark.createDataFrame(made, "doc_id long, toxic int")
        model = toxicity.fit(docs, labels)
        truth = dict(made)
        for own, good in ((model, True), (toxicity.Model(model.terms, model.bias, model.weights, model.factors * 0), False)):
            held = toxicity.scored(docs, own).where(toxicity.held_out(F.col("doc_id"))).collect()
            right = np.mean([int(r["score"] >= 0.3) == truth[r["doc_id"]] for r in held])
            assert (right > 0.9) == good


def test_pairs_beside_many_more_frequent_words(spark):
    """The exclusive or of two words, beside 1,700 words that are more frequent than both."""
    draw = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(4000):
        a, b = draw.random(2) < 0.5
        w = [f"word{k}" for k in np.flatnonzero(draw.random(1700) < 0.6)] + ["alpha"] * int(a) + ["beta"] * int(b)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a != b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = toxicity.scored(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([int(r["score"] >= 0.5) == labels[r["doc_id"]][1] for r in held]) > 0.95


def test_screen_counts_all_pairs(monkeypatch):
    """Blocks and the bound on single words lose no pair of the plain count."""
    draw = np.random.default_rng(4)
    at = [np.sort(draw.choice(np.arange(0, 400, 2), 60, replace=False)) for _ in range(600)]
    has = np.zeros((600, 400))
    for i, a in enumerate(at):
        has[i, a] = 1
    expected = draw.uniform(0.1, 0.6, 600)
    y = draw.random(600) < np.select([has[:, 10] * has[:, 20] == 1, has[:, 10] + has[:, 20] == 1], [expected**0.1, expected * 0.75], expected)
    miss, spread = y - expected, expected * (1 - expected)
    monkeypatch.setattr(toxicity, "APART", 3.0)
    monkeypatch.setattr(toxicity, "CHANCE", 1e9)
    monkeypatch.setattr(toxicity, "NormalDist", lambda: type("N", (), {"inv_cdf": staticmethod(lambda p: 0.0)}))
    off, var = has.T @ (has * miss[:, None]), has.T @ (has * spread[:, None])
    z = np.abs(off) / np.sqrt(var + 0.5)
    alone = np.diag(z)
    want = {(a, b) for a, b in zip(*np.nonzero((var >= 2) & (z >= 3.0) & (z >= 1.5 * np.maximum(alone[:, None], alone))), strict=True)}
    for block in (1, 1000, 1 << 24):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        got = toxicity.pairs_that_tell(at, miss, spread)
        assert {(int(got.words[a]), int(got.words[b])) for a, b in zip(got.one, got.other, strict=True)} == want
        assert np.allclose(got.effect, np.clip(off[got.words[got.one], got.words[got.other]] / var[got.words[got.one], got.words[got.other]], -4, 4), atol=1e-4)
    assert {(10, 20), (20, 10)} <= want, sorted(want)
    factors = toxicity.first_factors(got)
    a, b = np.searchsorted(got.words, [10, 20])
    assert factors[a] @ factors[b] > 0


def test_toxicity_score_is_the_double_sum(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    place = {int(t): k for k, t in enumerate(model.terms)}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.scored(docs.where("doc_id % 50 = 1"), model).collect():
        pieces = set(re.findall(r"[^\W_]+", texts[r["doc_id"]].lower()))
        has = sorted({place[t] for p in pieces for t in toxicity.word_terms(p) if t in place})
        x = model.bias + sum(model.weights[i] for i in has)
        x += sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(has) for j in has[:k])
        assert r[len(docs.columns)] == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-9)


def test_quality_score_is_the_cumulative_link(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    weights = dict(zip(model.terms.tolist(), model.weights.tolist(), strict=True))
    make, texts = quality.text_terms(), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.scored(docs.where("doc_id % 50 = 1"), model).collect():
        at, value = make(texts[r["doc_id"]])
        x = sum(weights.get(int(a), 0.0) * float(b) for a, b in zip(at, value, strict=True))
        at_most = [1 / (1 + np.exp(-(c - x))) for c in model.thresholds] + [1.0]
        share = np.diff([0.0, *at_most])
        assert r["expected_grade"] == pytest.approx(float(share @ model.grades), abs=1e-9)
        assert r["tail_probability"] == pytest.approx(float(share[-1]), abs=1e-9)


def test_whole_texts_are_read(spark):
    """Words behind punctuation and the ends of long texts, with and without blanks, count."""
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    long = " ".join(["word1"] * 30_000)
    rows = [(0, "word1 hello,scumbag"), (1, "you/scumbag"), (2, long + " scumbag"), (3, long), (4, "\u65e5" * 5000 + ",scumbag")]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert min(got[i] for i in (0, 1, 2, 4)) > 0.3 > got[3]
    assert toxicity.word_terms("\u65e5" * 60) != toxicity.word_terms("\u65e5" * 60 + "\u672c" * 500)
    assert quality.word_terms("\u65e5" * 60) != quality.word_terms("\u65e5" * 60 + "\u672c" * 500)
    assert quality.graded(spark.createDataFrame(rows, "doc_id long, text string"), labels).count() == 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = quality.graded(docs, labels).join(labels, "doc_id").where("held_out").groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] > 0.98 and kept[0] < 0.15
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("flagged")).collect()
    flagged = {r["toxic"]: r["flagged"] for r in rows}
    assert flagged[1] > 0.8 and flagged[0] < 0.02
